"""File-incremental, restartable ingestion by Structured Streaming.

The checkpoint replaces completion markers and locks: files that a finished
batch took are never taken again, and one query owns a checkpoint. A batch that
fails is run file by file, if asked for, so that a bad file costs only itself;
otherwise it is run again as a whole. A run log has a row per batch and file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    log: str | None = None,
    format: str = "json",
    files_per_batch: int | None = None,
    tolerant: bool = False,
    **options: str,
) -> int:
    """Process the files of a folder that are new since the last run; returns how many batches there were.

    A batch's output is a folder of its own under target, overwritten if the
    batch runs again, so that a restart repeats nothing and loses nothing.
    tolerant: a file that cannot be read or transformed gets a row with status
    failed and its error in the log, and the others of its batch are written.
    """
    batches = 0

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("source_file", F.col("_metadata.file_name"))

    def logged(counts: list[tuple], batch: int) -> None:
        if log:
            rows = spark.createDataFrame(counts, "source_file string, rows long, status string, error string")
            rows.withColumn("completed_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{log}/batch={batch}")

    def counted(rows: DataFrame) -> list[tuple]:
        # a row for each file of a batch
        return [(r.source_file, r.n, "done", None) for r in rows.groupBy("source_file").agg(F.count("*").alias("n")).collect()] if log else []

    def write(rows: DataFrame, batch: int, mode: str = "overwrite") -> list[tuple]:
        transform(rows).write.mode(mode).parquet(f"{target}/batch={batch}")
        return counted(rows)

    def whole(rows: DataFrame, batch: int) -> None:
        nonlocal batches
        batches += 1
        logged(write(rows, batch), batch)

    def by_file(files: DataFrame, batch: int) -> None:
        nonlocal batches
        batches += 1
        load = lambda paths: named(spark.read.format(format).schema(schema).options(**options).load(paths))
        paths = sorted(r.path for r in files.collect())
        try:
            out = write(load(paths), batch)
        except Exception:
            out, mode = [], "overwrite"
            for path in paths:
                try:
                    out += write(load([path]), batch, mode)
                    mode = "append"
                except Exception as e:
                    out.append((path.rpartition("/")[2], 0, "failed", str(e)[:1000]))
        logged(out, batch)

    # a tolerant run streams the names of files alone, and reads each batch of them as tables
    reader = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length LONG, content BINARY") if tolerant else spark.readStream.format(format).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.load(source)
    stream = stream.select("path") if tolerant else named(stream)
    stream.writeStream.foreachBatch(by_file if tolerant else whole).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return batches


def ingested(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def progress(query) -> list[dict]:
    """Rows and rows a second of each recent batch of a running query."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]
