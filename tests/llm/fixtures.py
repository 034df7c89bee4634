"""Small tables with every awkward case."""

from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "".join(chr(97 + (i * i * 31 + i // 7) % 26) if i % 6 else " " for i in range(40_000))


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def odd_documents(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (3, "one two three", "en", "a", 13), (1, None, None, None, None), (2, "", "en", "b", 0), (2, "", "en", "b", 0), (7, LONG, "de", "a", 40_000), (7, LONG, "de", "a", 40_000),
        (None, "id is missing", "en", None, 13), (5, " \t\n", "fr", "b", 3), (9, "日本語 \U0001f600 text", None, "a", 12), (5, "same id, other text", "fr", "c", 19),
    ]
    extra = {c: F.lit(None).cast("string") for c in ("k", "th", "fp", "key", "size", "label", "n", "bin", "score", "lang_pred", "skey", "copies", "_text", "piece", "start", "base", "spans", "_id", "cut", "doc", "left")}
    return spark.createDataFrame(rows, DOCUMENTS).withColumns(extra)
