"""Writers. All overwrite, so that running again gives the same table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_model_name


def write_jsonl(rows: DataFrame, path: str, compression: str = "bzip2") -> None:
    rows.write.mode("overwrite").option("compression", compression).json(path)


def write_csv(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """CSV with a header; raises for an empty table."""
    if rows.isEmpty():
        raise ValueError("no rows to write")
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"')
    (writer.option("compression", compression) if compression else writer).csv(path)


def null_for_non_finite(rows: DataFrame) -> DataFrame:
    """NaN and infinities as null, for formats that have none."""
    return rows.select(*(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metric table as one CSV and one JSON file."""
    safe = null_for_non_finite(metrics).coalesce(1)
    write_csv(safe, f"{path}/csv")
    write_jsonl(safe, f"{path}/json", "none")


def write_benchmark(results: DataFrame, predictions: DataFrame, config: dict[str, object], path: str, model: str = "model_name") -> None:
    """Results as CSV and JSON, a JSON folder for each model under its safe name, predictions as CSV, and the run's configuration as JSON."""
    spark = results.sparkSession
    write_metrics(results, f"{path}/benchmark_summary")
    names = null_for_non_finite(results).withColumn("model_file", safe_model_name(F.col(model), "prompting"))
    names.repartition("model_file").write.mode("overwrite").partitionBy("model_file").json(f"{path}/model_summaries")
    if not predictions.isEmpty():
        write_csv(predictions, f"{path}/benchmark_predictions")
    spark.createDataFrame([(json.dumps(config, ensure_ascii=False, indent=2, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/run_config")


def write_page_citations(stats: DataFrame, path: str) -> None:
    """Per-page citation statistics, means to six places."""
    write_csv(stats.withColumn("avg_citations", F.format_string("%.6f", "avg_citations")), path)
