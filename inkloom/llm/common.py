"""What several operators share: scratch tables in the shared folder, joins with a
checked broadcast, and connected components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast; their rows are narrow (a few dozen bytes).
BROADCAST_ROWS = 100_000
#: Salts of the other side when the small side is too large to broadcast.
SALTS = 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests on local[*]) a temporary one."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_root(spark.sparkContext.applicationId)


@functools.cache
def _local_root(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix=f'inkloom-{application}-')}"


def scratch_folder(spark: SparkSession) -> str:
    """Where this application's scratch tables are."""
    return f"{scratch_root(spark)}/inkloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that still read them are lost."""
    _delete(spark, scratch_folder(spark))


@contextlib.contextmanager
def cleaned_shuffles(spark: SparkSession):
    """Shuffle files of the executions inside go as each ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    with cleaned_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._inkloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind materialize()'s results once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_inkloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def checked_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt: Column | None = None) -> DataFrame:
    """left join small on keys that may be hot on the left and are unique on the right.

    small is counted: up to BROADCAST_ROWS rows it is broadcast, and beyond that
    both sides are salted, so that a hot key is spread over SALTS tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), on, how)
    spread = left.withColumn("_salt", F.pmod(salt if salt is not None else F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """edges written as a table, and their number and checksum, taken along while they are written."""
    seen = Observation()
    stored = materialize(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), name)
    return stored, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of each node of edges (u long, v long); component is the smallest id reachable.

    Alternating large-star and small-star rewriting. Neighbourhoods are never
    collected: each step is a minimum per node, which Spark combines before the
    shuffle, and a join of the edges to it, which adaptive execution splits at
    hot nodes. Each round is written to the shared folder. Self-loops, repeated
    edges and an empty table are allowed.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, seen = _counted(edges, name)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after, now = _counted(small.where("u <> v").distinct(), name)
        discard(edges)
        edges, before, seen = after, seen, now
        if before == now:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
