"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .langid import op6_language_bitmasks
from .lpf_dedup import OP9_SQL, op9_repeated_strings
from .media import op5_iso_media
from .mixing import OP2_SQL, op2_source_mixing
from .multi_index import OP7_SQL, op7_inverted_multi_index
from .packing import op4_best_fit_packing
from .pii import BASE_SQL, op3_weak_supervision_pii, pii_base_spans
from .simhash import op10_simhash_tiles
from .token_store import op1_token_orc
from .toxicity import op8_toxicity_cnn


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_token_orc": op1_token_orc,
        "op2_source_mixing": op2_source_mixing,
        "op3_weak_supervision_pii": op3_weak_supervision_pii,
        "pii_base_spans": pii_base_spans,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_iso_media": op5_iso_media,
        "op6_language_bitmasks": op6_language_bitmasks,
        "op7_inverted_multi_index": op7_inverted_multi_index,
        "op8_toxicity_cnn": op8_toxicity_cnn,
        "op9_repeated_strings": op9_repeated_strings,
        "op10_simhash_tiles": op10_simhash_tiles,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": OP2_SQL, "pii_base_spans": BASE_SQL, "op7_inverted_multi_index": OP7_SQL, "op9_repeated_strings": OP9_SQL}
