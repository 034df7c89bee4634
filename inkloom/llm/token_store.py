"""Token ids in ORC: integer run-length encoded lists, row indexes and Bloom filters on doc_id.

Shards are ranges of doc_id in ascending order, and rows are in that order
within a shard, so that stripe and row-group statistics on doc_id are tight
ranges. Readers split shards at stripes; a look-up of some documents prunes
files and stripes by statistics and row groups by the Bloom filter.

Defined cases: a null text is empty and gives the end id alone; a null doc_id
sorts first; rows with the same doc_id are ordered by text and each is stored;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, materialize, partitions, scratch_path, text_or_empty
from .encoding import default_tokenizer, encoder, small_batches

SCHEMA = "shard int, seq long, doc_id long, tokens array<int>"
#: Documents hold thousands of ids, so that a row group has fewer rows than ORC's default.
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
}


#: Bytes of input for each shard, about; there are no fewer shards than shuffle partitions.
SHARD_BYTES = 256 << 20


def shards_for(docs: DataFrame) -> int:
    """Shards of a table by what Spark's statistics say of its size, so that a shard does not grow with the input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # without statistics Spark takes tables for huge
    return max(partitions(docs.sparkSession), min(-(-size // SHARD_BYTES), 1 << 17) if size < 1 << 60 else 0)


def by_range(docs: DataFrame, shards: int) -> DataFrame:
    """docs dealt to ranges of doc_id, nulls first.

    The bounds come from quantiles of the ids, which read that column alone;
    repartitionByRange would read the texts once more to sample them.
    """
    cuts = F.array(*(F.lit(i / shards) for i in range(1, shards)))
    found = docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * shards)).alias("q")).first().q if shards > 1 else None
    bounds = sorted(set(found or []))
    # one literal however many bounds there are, searched in halves
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    rows = docs.withColumn("_shard", F.lit(0))
    step = 1 << max(0, len(bounds).bit_length() - 1)
    while bounds and step:
        at = F.get(table, F.col("_shard") + (step - 1))
        rows = rows.withColumn("_shard", F.col("_shard") + F.when(F.col("doc_id") >= at, step).otherwise(0))
        step //= 2
    return rows.repartitionById(len(bounds) + 1, F.col("_shard")).drop("_shard")


def write_token_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> None:
    """Encode whole texts and write them as ORC shards under path."""
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches):
        seq = 0
        for batch in batches:
            for part, texts in small_batches(batch):
                sizes, flat = encoder(tokenizer, end_id).encode(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(seq, seq + len(texts))), part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["seq", "doc_id", "tokens"],
                )
                seq += len(texts)

    ranges = by_range(docs.select("doc_id", text_or_empty().alias("text")), shards or shards_for(docs))
    encoded = ranges.sortWithinPartitions("doc_id", "text").mapInArrow(encode, "seq long, doc_id long, tokens array<int>")
    encoded.select(F.spark_partition_id().alias("shard"), "seq", "doc_id", "tokens").write.options(**ORC_OPTIONS).orc(path)


def read_token_shards(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; doc_ids are pushed down to file, stripe and Bloom filter pruning."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document.

    start is a two-level prefix sum: one total per shard (a narrow table, joined
    under checked_join), and a running sum within each shard.
    """

    def digest(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])), np.int64, len(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("seq"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc)],
                ["shard", "seq", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = materialize(stored.mapInArrow(digest, "shard int, seq long, doc_id long, n_tokens long, ids_crc32 long"), "digests")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n_tokens")
    local = rows.withColumn("inner", inner)
    return checked_join(local, before, ["shard"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digests(read_token_shards(spark, path))
