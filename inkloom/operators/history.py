"""Operators on revision histories.

Rows are revisions with an explicit ordinal, since tables have no order:
page_id, ordinal, revision_id, timestamp (text), username, is_bot and more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow_text import normalized_text
from ..functions.text import citation_count, reference_tag_count

# Parts of names and comments that mark automated edits.
BOT_MARKS = ("bot", "auto", "script", "crawler", "spider")


def revisions_of_pages(pages: DataFrame) -> DataFrame:
    """A row per revision of main-namespace dump pages; ordinal is its place in the page."""
    main = pages.where("ns = '0'")
    return main.select(F.col("id").alias("page_id"), F.col("title").alias("page_title"), F.posexplode("revision").alias("ordinal", "r")).select(
        "page_id",
        "page_title",
        F.col("ordinal").cast("long"),
        F.col("r.id").alias("revision_id"),
        F.col("r.timestamp").alias("timestamp"),
        F.col("r.contributor").alias("contributor"),
        F.col("r.comment").alias("comment"),
        F.coalesce("r.text", F.lit("")).alias("raw_text"),
    )


def with_contributor(revisions: DataFrame) -> DataFrame:
    """user_id, username and is_anonymous from the contributor: without a name its address is the name, even a missing one."""
    who = F.col("contributor")
    return revisions.withColumns(
        {
            "user_id": who["id"],
            "username": F.coalesce(who["username"], who["ip"]),
            "is_anonymous": who.isNotNull() & who["username"].isNull(),
        }
    ).drop("contributor")


def is_bot_by_marks(username: Column, comment: Column) -> Column:
    out = F.lit(False)
    for mark in BOT_MARKS:
        for text in (username, comment):
            out = out | F.coalesce(F.lower(text).contains(mark), F.lit(False))
    return out


def with_bots(revisions: DataFrame, bots: DataFrame) -> DataFrame:
    """is_bot: an exact name of the bot list (column value, a small dimension), or a mark in name or comment."""
    listed = bots.select(F.trim("value").alias("username")).where("username <> ''").distinct().withColumn("_listed", F.lit(True))
    joined = revisions.join(F.broadcast(listed), "username", "left") if listed.limit(100_001).count() <= 100_000 else revisions.join(listed, "username", "left")
    flag = F.coalesce("_listed", F.lit(False)) | is_bot_by_marks(F.col("username"), F.col("comment"))
    return joined.withColumn("is_bot", flag).drop("_listed")


def clean_revisions(revisions: DataFrame) -> DataFrame:
    """clean_text, lengths and citation counts; rows without clean text or timestamp go."""
    out = revisions.withColumn("clean_text", normalized_text("raw_text")).withColumns(
        {"raw_text_len": F.char_length("raw_text"), "clean_text_len": F.char_length("clean_text"), "citation_count": citation_count("raw_text")}
    )
    return out.where("clean_text <> '' and timestamp <> ''")


def _in_page(*order: str):
    return Window.partitionBy("page_id").orderBy(*order)


def with_parent(revisions: DataFrame) -> DataFrame:
    """parent_revision_id: the retained revision before it in its page, or null."""
    return revisions.withColumn("parent_revision_id", F.lag("revision_id").over(_in_page("ordinal")))


def without_bots(revisions: DataFrame) -> DataFrame:
    return revisions.where(~F.coalesce("is_bot", F.lit(False)))


def collapse_runs(revisions: DataFrame) -> DataFrame:
    """The last revision of each run of one user, after bots are gone; unnamed users are one user."""
    kept = without_bots(revisions)
    window = _in_page("ordinal")
    following = kept.withColumns({"_next": F.lead("username").over(window), "_last": F.lead(F.lit(1)).over(window).isNull()})
    return following.where(F.col("_last") | ~F.col("username").eqNullSafe(F.col("_next"))).drop("_next", "_last")


def nested_pages(revisions: DataFrame, *keys: str) -> DataFrame:
    """A row per page with its revisions by timestamp, then file order."""
    keys = keys or ("page_id",)
    rest = [c for c in revisions.columns if c not in keys]
    order = F.struct(F.coalesce("timestamp", F.lit("")).alias("at"), F.col("ordinal").alias("n"), F.struct(*rest).alias("r"))
    grouped = revisions.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("rs"))
    return grouped.select(*keys, F.transform("rs", lambda x: x["r"]).alias("revisions"))


def latest_by_id(revisions: DataFrame, *columns: str) -> DataFrame:
    """Per page the revision with the greatest (timestamp, revision_id)."""
    key = F.struct(F.coalesce("timestamp", F.lit("")), F.coalesce(F.col("revision_id").cast("long"), F.lit(-1)))
    best = F.max_by(F.struct(*columns), key).alias("best")
    return revisions.groupBy("page_id").agg(best).select("page_id", "best.*")


def latest_in_order(pages: DataFrame) -> DataFrame:
    """Per nested page its last revision: ties of timestamps by file order."""
    return pages.withColumn("latest", F.try_element_at("revisions", F.lit(-1))).drop("revisions")


def safe_username(username: Column, user_id: Column) -> Column:
    return F.coalesce(F.nullif(username, F.lit("")), F.concat(F.lit("user_id:"), user_id.cast("string")), F.lit("<unknown>"))


def bot_counts(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("page_id").agg(F.count("*").alias("revisions"), F.count_if(F.coalesce("is_bot", F.lit(False))).alias("bot_revisions"))


def citation_stats(revisions: DataFrame) -> DataFrame:
    """Per page: revisions, total, largest and mean citation count. Counts that are missing or no integers are 0."""
    n = F.coalesce(F.col("citation_count").cast("string").try_cast("long"), F.lit(0))
    return revisions.groupBy("page_id").agg(
        F.count("*").alias("revision_count"),
        F.sum(n).alias("total_citations"),
        F.max(n).alias("max_citations"),
        F.round(F.sum(n) / F.count("*"), 6).alias("avg_citations"),
        F.count_if(F.col("citation_count").isNull()).alias("missing_counts"),
    )


def citation_summary(stats: DataFrame) -> DataFrame:
    revisions, total = F.sum("revision_count"), F.sum("total_citations")
    return stats.agg(
        F.count("*").alias("pages"),
        F.coalesce(revisions, F.lit(0)).alias("revisions"),
        F.coalesce(total, F.lit(0)).alias("total_citations"),
        F.round(total / F.nullif(F.count("*"), F.lit(0)), 6).alias("avg_per_page"),
        F.round(total / F.nullif(revisions, F.lit(0)), 6).alias("avg_per_revision"),
        F.count_if(F.col("total_citations") == 0).alias("zero_citation_pages"),
        F.coalesce(F.sum("missing_counts"), F.lit(0)).alias("missing_counts"),
    )


def citation_recount(revisions: DataFrame) -> DataFrame:
    """One row: stored citation counts against a plain recount of reference tags, and how many revisions differ."""
    stored, again = F.coalesce(F.col("citation_count").cast("long"), F.lit(0)), reference_tag_count("raw_text")
    counted = revisions.select(stored.alias("stored"), again.alias("recounted"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return counted.agg(F.count("*").alias("revisions"), total("stored"), total("recounted"), F.count_if(F.col("stored") != F.col("recounted")).alias("mismatches"))


def of_first_pages(rows: DataFrame, most: int | None, zero: str = "all", page: str = "page_id") -> DataFrame:
    """The rows of the first `most` pages by id; None is no limit. 0 is none either (`all`), or stands for 1 (`one`).

    Both meanings of 0 are in use: preprocessing takes it for no limit, and
    ranking looks at its limit only after a page is done.
    """
    if zero not in ("all", "one"):
        raise ValueError(f"unknown meaning of zero: {zero}")
    if most is None or (most == 0 and zero == "all"):
        return rows
    first = rows.select(page).distinct().orderBy(page).limit(max(1, most) if zero == "one" else most)
    return rows.join(first, page, "left_semi")


def top_pages(stats: DataFrame, k: int) -> DataFrame:
    """The k pages with most citations, ranked; k <= 0 gives none. Sorted by a top-k operator, never in full."""
    first = stats.orderBy(F.desc("total_citations"), F.desc("page_id")).limit(max(0, k))
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_citations"), F.desc("page_id"))))
