"""A corpus pipeline: language ID, near-duplicates, personal data, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

Defined cases: those of the operators; a null text has no letter and is
rejected by the first stage, so that later ones have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import langid, mixing, packing, pii, simhash
from inkloom.llm.common import materialize

#: Least similarity of near duplicates.
SIMILARITY = 0.8


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: rejected are those without letters and those whose n-grams no language knows."""
    found = langid.identified(docs, langid.fit(docs), list(docs.columns), "_inkloom_")
    return found.where((F.col("_inkloom_lang_pred") != langid.UND) & (F.col("_inkloom_known") >= langid.LEAST_KNOWN)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): that with the smallest id.

    Documents without an id come last. Rows that share an id but not their text
    are documents of their own, of which those with other groups stay; of rows
    equal in id and text one stays, and which is not defined where their other
    columns differ.
    """
    removed, repeated = simhash.survivors(docs, SIMILARITY)
    doc = F.struct(*docs.columns).alias("_inkloom_doc")
    rows = docs.select(doc, *simhash.names_of("doc_id", "text"))
    out = removed.union(repeated)
    alone = simhash.narrowed(rows, materialize(out, "dropped"), ["row", "mark"], "left_anti")
    one = simhash.narrowed(rows, repeated, ["row", "mark"]).dropDuplicates(["row", "mark"])
    return alone.select("_inkloom_doc.*").unionByName(one.select("_inkloom_doc.*"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; the last of a source may be cut."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: SQL has no fitted language model or byte-pair encoding; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
