"""Paragraphs, sentences, citations and labels of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow_text, text as T

# The least length of prose, and the category links that no prose holds.
MIN_PARAGRAPH = 50
CATEGORY = r"\[\[Thể loại:.*?\]\]"

Splitter = Callable[[Column], Column]


def prose(paragraph: Column, least: int = MIN_PARAGRAPH) -> Column:
    """Whether a block is prose: not short, no list, table, tag or category. Measured before links are replaced."""
    return (F.char_length(paragraph) >= least) & ~paragraph.rlike(r"^[*#|<]") & ~paragraph.rlike(CATEGORY)


def page_paragraphs(pages: DataFrame, least: int = MIN_PARAGRAPH) -> DataFrame:
    """page_id, paragraph_id, header, text_raw of the prose of pages (page_id, raw_text).

    Markup is stripped row by row in Arrow batches, and headings are carried
    forward within each page's array of blocks by a fold, so that nothing is
    shuffled. paragraph_id counts prose blocks from 0.
    """
    blank = F.coalesce(T.strip("raw_text"), F.lit("")) == ""
    stripped = pages.where(~blank).withColumn("_text", arrow_text.stripped_page("raw_text"))
    blocks = T.paragraphs("_text")
    start = F.struct(F.lit(None).cast("string").alias("header"), F.array().cast("array<struct<header:string,text:string>>").alias("out"))

    def step(acc: Column, block: Column) -> Column:
        header = F.coalesce(T.heading(block), acc["header"])
        rest = T.after_heading(block)
        item = F.struct(header.alias("header"), rest.alias("text"))
        return F.struct(header.alias("header"), F.when(prose(rest, least), F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    kept = stripped.select("page_id", F.posexplode(F.aggregate(blocks, start, step, lambda acc: acc["out"])).alias("paragraph_id", "p"))
    return kept.select("page_id", "paragraph_id", F.col("p.header").alias("header"), T.link_text(T.remove_emphasis(F.col("p.text"))).alias("text_raw"))


def split_sentences(paragraph: Column) -> Column:
    """Default splitter: after closing punctuation and white space before a capital, digit or quote, and at line breaks."""
    ended = F.regexp_replace(paragraph, rf"([.!?…][\"'”’)\]]*){T.WS}+(?=[\"'“‘(\[]?[\p{{Lu}}\p{{N}}])", "$1\n")
    return F.filter(F.transform(F.split(ended, "\n+"), T.strip), lambda s: s != "")


def attributed(paragraph: Column, sentences: Column) -> Column:
    """Whether each sentence is cited, as array<struct<index,text,has_citation>>.

    Sentences are matched from the end of the last match on, in the paragraph
    without reference tags. A tag at a sentence's end is its own, and so are
    numeric citations in it or right after it. A sentence that is not found is
    uncited and leaves the place.
    """
    clean, refs = T.without_refs(paragraph), T.ref_positions(paragraph)
    item = "array<struct<index:int,text:string,has_citation:boolean>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(item).alias("out"))

    def step(acc: Column, sentence: Column) -> Column:
        place = F.call_function("locate", sentence, clean, acc["at"] + 1) - 1
        end = place + F.char_length(sentence)
        tagged = F.exists(refs, lambda p: (p >= place) & (p <= end))
        cited = (place >= 0) & (tagged | T.has_numeric_citation(sentence, F.substring(clean, end + 1, F.lit(32))))
        one = F.struct(F.size(acc["out"]).alias("index"), sentence.alias("text"), cited.alias("has_citation"))
        return F.struct(F.when(place >= 0, end).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(sentences, start, step, lambda acc: acc["out"])


def page_sentences(paragraphs: DataFrame, splitter: Splitter = split_sentences) -> DataFrame:
    """Paragraphs with text_clean and sentences; those without a sentence go. Another splitter is any Column function or pandas UDF."""
    raw = T.tidy_inline(T.remove_invisible(arrow_text.nfc("text_raw")))
    tidy = paragraphs.withColumn("text_raw", raw).withColumn("text_clean", T.tidy_inline(T.without_refs("text_raw")))
    split = tidy.withColumn("_sentences", splitter(F.col("text_clean")))
    return split.withColumn("sentences", attributed(F.col("text_raw"), F.col("_sentences"))).drop("_sentences").where(F.size("sentences") > 0)


def nested_sentences(sentences: DataFrame) -> DataFrame:
    """A row per page with its paragraphs in order."""
    columns = [c for c in sentences.columns if c not in ("page_id", "title")]
    keys = [c for c in ("page_id", "title") if c in sentences.columns]
    return sentences.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("paragraph_id", *(c for c in columns if c != "paragraph_id")))).alias("paragraphs"))


def flat_sentences(pages: DataFrame) -> DataFrame:
    """page_id, paragraph_id, index, text, has_citation of nested pages; without has_citation, label 1 means cited."""
    paragraphs = pages.select("page_id", F.posexplode("paragraphs").alias("position", "p"))
    return paragraphs.select("page_id", F.coalesce("p.paragraph_id", "position").alias("paragraph_id"), F.posexplode("p.sentences").alias("index", "s")).select(
        "page_id", "paragraph_id", "index", F.col("s.text").alias("text"), F.coalesce("s.has_citation", F.lit(False)).alias("has_citation")
    )


def prefix_labels(sentences: DataFrame, *paragraph: str, order: str = "index") -> DataFrame:
    """text, label: cited sentences are 1, those before the first cited one, or of an uncited paragraph, 0; the rest go.

    Blank sentences go first.
    """
    keys = paragraph or ("page_id", "paragraph_id")
    clean = sentences.withColumn("text", T.strip("text")).where("text <> ''").withColumn("has_citation", F.coalesce("has_citation", F.lit(False)))
    first = F.min(F.when(F.col("has_citation"), F.col(order))).over(Window.partitionBy(*keys))
    labelled = clean.withColumn("_first", first).withColumn("label", F.when(F.col("has_citation"), 1).when(F.col("_first").isNull() | (F.col(order) < F.col("_first")), 0))
    return labelled.where("label is not null").drop("_first")


def nested_prefix_labels(pages: DataFrame) -> DataFrame:
    """prefix_labels of nested pages within each row, without a shuffle."""
    paragraphs = pages.select("page_id", F.explode("paragraphs").alias("p"))
    tidy = F.filter(F.transform("p.sentences", lambda s: F.struct(T.strip(s["text"]).alias("text"), F.coalesce(s["has_citation"], F.lit(False)).alias("cited"))), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    listed = paragraphs.select("page_id", tidy.alias("s")).withColumn("first", F.array_position(F.transform("s", lambda x: x["cited"]), F.lit(True)))
    rows = listed.select("page_id", "first", F.posexplode("s").alias("i", "x"))
    label = F.when(F.col("x.cited"), 1).when((F.col("first") == 0) | (F.col("i") + 1 < F.col("first")), 0)
    return rows.select("page_id", F.col("x.text").alias("text"), label.alias("label")).where("label is not null")
