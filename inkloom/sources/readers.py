"""Readers with the malformed-data policy of each table.

Compressed files are read by Spark's codecs. Listing goes through Hadoop's file
system API, so that any store works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..functions.text import model_text, strip, word_count
from . import schemas


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".bz2",), most: int | None = None) -> list[str]:
    """Files of a folder with one of the suffixes, by name; the path itself if it is a file. Raises if there is none.

    most: no more than so many, the first ones (0 or None: all).
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(where):
        raise FileNotFoundError(path)
    found = [s.getPath() for s in store.listStatus(where) if s.isFile()]
    out = sorted(str(p) for p in found if p.getName().endswith(suffixes))
    if not out:
        raise FileNotFoundError(f"{path} has no {' or '.join(suffixes)} file")
    return out[:most] if most else out


def resolved(spark: SparkSession, explicit: str | None, candidates: list[str]) -> str:
    """The explicit path, which must exist, or else the first candidate that does."""
    for path in [explicit] if explicit else candidates:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            return path
    raise FileNotFoundError(explicit or f"none of {candidates}")


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages of XML dumps, any compression; white space in texts is kept."""
    reader = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("mode", "FAILFAST")
    return reader.schema(schemas.PAGE).load(path if isinstance(path, str) else ",".join(path))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, policy: str = "fail") -> DataFrame:
    """JSON lines: bad lines `fail` the read, are `skip`ped, or are kept for `count`ing as _corrupt_record."""
    reader = spark.read.option("mode", {"fail": "FAILFAST", "skip": "DROPMALFORMED", "count": "PERMISSIVE"}[policy])
    if policy == "count":
        schema = f"{schema}, _corrupt_record STRING"
    return reader.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str, required: tuple[str, ...] = (), multiline: bool = True) -> DataFrame:
    """CSV with a header, doubled quotes and line breaks in values; raises for missing columns or no rows.

    Without multiline, where no value has a line break, large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("mode", "FAILFAST").option("maxCharsPerColumn", -1)
    header = reader.csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = reader.schema(schema).option("enforceSchema", False).csv(path)
    if required and out.isEmpty():
        raise ValueError(f"{path} has no rows")
    return out


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One stripped name a line; an absent file is an empty list."""
    try:
        return spark.read.text(resolved(spark, path, [])).select(strip("value").alias("value")).where("value <> ''").distinct()
    except FileNotFoundError:
        return spark.createDataFrame([], "value string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, source_line: lines of one file numbered from 1, blank ones included.

    Numbers follow the blocks of the file: counts of lines per input partition
    are added up (a row for each partition), so that no task sees all lines.
    """
    lines = spark.read.text(path).withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    counts = lines.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    starts = counts.withColumn("start", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))
    joined = lines.join(starts, "_part")
    return joined.select(F.col("value").alias("line"), (F.col("_id") - F.col("first") + F.col("start") + 1).alias("source_line"))


def _rule(conditions: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks, or null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(conditions):
        out = F.when(broken, name).otherwise(out)
    return out


def parsed_examples(lines: DataFrame, kind: str = "training") -> DataFrame:
    """Example lines with `rule`, the first rule that each breaks: blank, bad_json, missing_fields, empty_text, bad_label, bad_perplexity.

    kind "training" takes labels that equal 0 or 1 and keeps bad perplexities as
    NaN; "prompting" takes labels that are integers when cut, and drops bad
    perplexities. line and source_line come from numbered_lines().
    """
    # bare infinities and NaN, which JSON lacks, are quoted first
    json = F.regexp_replace("line", r"(:\s*)(-?Infinity|NaN)(\s*[,}])", '$1"$2"$3')
    raw = [F.get_json_object(json, f"$.{k}") for k in ("text", "label", "perplexity_score")]
    keys = F.json_object_keys(json)
    quoted = F.regexp_extract("line", r'"label"\s*:\s*(")', 1) != ""
    number = F.when(raw[1].isin("true", "false"), (raw[1] == "true").cast("double")).otherwise(raw[1].try_cast("double"))
    if kind == "training":
        label = F.when(~quoted & number.isin(0.0, 1.0), number.cast("int"))
    else:
        label = F.when(quoted, strip(raw[1]).try_cast("int")).otherwise(number.try_cast("int"))
        label = F.when(label.isin(0, 1), label)
    perplexity = F.when(raw[2].isin("Infinity", "inf"), float("inf")).when(raw[2] == "-Infinity", float("-inf")).when(raw[2] == "NaN", float("nan")).otherwise(raw[2].try_cast("double"))
    good = F.coalesce(finite(perplexity), F.lit(False))
    text = model_text(raw[0])
    rules = [
        ("blank", strip("line") == ""),
        ("bad_json", keys.isNull()),
        ("missing_fields", ~F.array_contains(keys, "text") | ~F.array_contains(keys, "label")),
        ("empty_text", F.coalesce(text, F.lit("")) == ""),
        ("bad_label", label.isNull()),
    ]
    if kind != "training":
        rules.append(("bad_perplexity", ~good))
    parsed = lines.select("source_line", text.alias("text"), label.alias("label"), F.when(good, perplexity).otherwise(F.lit(float("nan"))).alias("perplexity_score"), _rule(rules).alias("rule"))
    return parsed.withColumn("text_len_ws", word_count("text"))


def load_examples(spark: SparkSession, path: str, kind: str = "training") -> tuple[DataFrame, DataFrame]:
    """(valid examples, counts by broken rule)."""
    parsed = parsed_examples(numbered_lines(spark, path), kind)
    counts = parsed.groupBy(F.coalesce("rule", F.lit("valid")).alias("rule")).agg(F.count("*").alias("n"))
    return parsed.where("rule is null").drop("rule"), counts
