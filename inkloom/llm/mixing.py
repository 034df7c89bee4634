"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source, ranges of keys are
buckets: per-bucket totals give distributed prefix sums of word counts in key
order, and each source is cut at its exact budget. A budget above a source's
size repeats the whole source (epochs) before the cut. Buckets follow from the
hash, so that a source with a third of all rows is spread evenly without
sampling, and their number follows from the rows and the shuffle partitions.

Defined cases: a null text has size 0 and takes nothing; the null source is a
source of its own, the last; repeated rows are taken one by one; a source
without words has target 0; an empty table gives no rows; other columns are kept
by mixed_documents and ignored by mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, materialize, partitions, text_or_empty

SEED = "mix-1"
EPOCHS = 3  # most times that a source is repeated
WORDS = r"[^\x20\x09-\x0D]+"
_KEY_BITS = 60


def words(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORDS)).cast("long")


def mixing_key(seed: str = SEED) -> Column:
    """60 bits of an md5 of the seed, the id and the text, so that SQL engines agree on it."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty()))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_key() -> Column:
    """A key that is never null: joins then keep the null source."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", "source", source_key().alias("skey"), words().alias("size"), mixing_key(seed).alias("key"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """skey, source_size, n, target, epochs, rest. One row per source.

    Weights 1, 2, 3 repeat over the sources by code point. The shares are a water
    level: in order of cap per weight, the sources before the first that stays
    below its cap are capped, and the rest share what is left by weight.
    """
    totals = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "skey")
    weighted = totals.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * EPOCHS)
    levels = (
        weighted.withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - (F.sum("cap").over(by_cap) - F.col("cap")))
        .withColumn("over", F.sum("weight").over(Window.partitionBy()) - (F.sum("weight").over(by_cap) - F.col("weight")))
        .withColumn("level", F.col("left") / F.col("over"))
    )
    level = F.coalesce(F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(Window.partitionBy()), F.lit(0.0))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    planned = levels.withColumn("target", target).withColumn("budget", F.round("target").cast("long"))
    size = F.greatest("source_size", F.lit(1))
    return planned.select("skey", "source_size", "n", "target", F.floor(F.col("budget") / size).cast("long").alias("epochs"), (F.col("budget") % size).alias("rest"))


def _placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """sizes with the targets' columns and `before`: the words of its source with smaller keys."""
    spark = sizes.sparkSession
    total = max(1, sizes.count())
    buckets = F.ceil(F.col("n") * (2 * partitions(spark)) / total)
    rows = checked_join(sizes, targets, ["skey"], salt=F.col("key")).withColumn("bucket", F.floor(F.col("key").cast("double") * buckets / F.lit(float(1 << _KEY_BITS))).cast("long"))
    totals = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"))
    starts = totals.select("skey", "bucket", (F.sum("words").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("words")).alias("start"))
    order = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("inner", F.sum("size").over(order) - F.col("size"))
    return checked_join(inner, starts, ["skey", "bucket"], salt=F.col("key")).withColumn("before", F.col("start") + F.col("inner"))


def _last_epoch() -> Column:
    return F.least(F.greatest(F.col("rest") - F.col("before"), F.lit(0)), F.col("size"))


def mixture(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    sizes = materialize(sized(docs, seed), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    taken = F.col("epochs") * F.col("size") + _last_epoch()
    return _placed(sizes, targets).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken; a last part is its first words.

    Only one row per source is joined to the texts: the key at which the last
    epoch ends, and the words left there. Texts are never shuffled, but for the
    few that share a source's last key.
    """
    sizes = materialize(sized(docs, seed), "sizes")
    targets = materialize(source_targets(sizes), "targets")
    last = _placed(sizes, targets).where("before < rest").groupBy("skey").agg(F.max(F.struct("key", -F.col("before"))).alias("last"))
    cuts = last.select("skey", F.col("last.key").alias("cut_key"), F.col("last").getField("col2").alias("cut_start"))
    plan = materialize(targets.select("skey", "epochs", "rest").join(cuts, "skey", "left").select("skey", "epochs", "cut_key", (F.col("rest") + F.col("cut_start")).alias("cut_words")), "cuts")
    names = docs.columns
    kept = docs.select(F.struct(*names).alias("doc"), mixing_key(seed).alias("key"), source_key().alias("skey"))
    rows = checked_join(kept, plan, ["skey"], salt=F.col("key"))
    copies = (F.col("epochs") + F.when(F.col("key") < F.col("cut_key"), 1).otherwise(0)).cast("int")
    whole = rows.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
    tied = Window.partitionBy("skey", "key").orderBy("doc.doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where("key = cut_key").withColumn("size", words("doc.text"))
    ends = ends.withColumn("left", F.least("size", F.col("cut_words") - F.sum("size").over(tied) + F.col("size"))).where("left > 0")
    text = F.when(F.col("left") < F.col("size"), first_words(F.col("doc.text"), F.col("left"))).otherwise(F.col("doc.text"))
    cut = F.col("doc").withField("text", F.col("cut"))
    if "n_chars" in names:
        cut = cut.withField("n_chars", F.char_length("cut").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(ends.withColumn("cut", text).select(cut.alias("doc")).select("doc.*"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER () - (sum(cap) OVER c - cap)) / (sum(weight) OVER () - (sum(weight) OVER c - weight)) AS level
  FROM w WINDOW c AS (ORDER BY cap / weight, source NULLS FIRST)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0)) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (budget // greatest(source_size, 1) * size + least(greatest(budget % greatest(source_size, 1) - before, 0), size))::BIGINT AS taken
FROM p
"""
