"""Selection of articles by two methods, with the reports on them.

Input: page_id (string), quality_score, citation_count. Output of both methods
is the k best with their rank. Sorting is always a top-k or a global aggregate;
scores are never collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles, value_counts, values_at, with_quantiles
from .scalars import with_scalars


def page_order(page_id: Column) -> list[Column]:
    """Numeric ids first by number, then the others by text."""
    numeric = page_id.rlike("^[0-9]+$")
    return [F.when(numeric, 0).otherwise(1), F.when(numeric, page_id.try_cast("decimal(38,0)")), page_id]


def _ranked(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    first = rows.orderBy(*order).limit(max(0, k))
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def quality_pool(rows: DataFrame, k: int) -> DataFrame:
    """All articles at or above the k-th quality.

    The cutoff is the least of the k best qualities: one top-k, joined back as a
    single value, so that ties enlarge the pool without a global ranking.
    """
    quality = F.col("quality_score")
    cutoff = rows.orderBy(quality.desc(), F.desc("citation_count"), *page_order(F.col("page_id"))).limit(max(0, k)).agg(F.min("quality_score").alias("quality_cutoff"))
    return with_scalars(rows, cutoff).where(quality >= F.col("quality_cutoff")).drop("quality_cutoff")


def by_quality_then_citations(rows: DataFrame, k: int) -> DataFrame:
    """Of the articles at or above the k-th quality the k with most citations."""
    return _ranked(quality_pool(rows, k), [F.desc("citation_count"), F.desc("quality_score"), *page_order(F.col("page_id"))], k)


def weights(quality: float, citation: float) -> tuple[float, float]:
    total = quality + citation
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    return quality / total, citation / total


def by_weighted_z(rows: DataFrame, k: int, w_quality: float = 0.7, w_citation: float = 0.3, ranked: bool = True) -> DataFrame:
    """The k largest weighted sums of population z-scores, rounded to 10 places before they are compared; all rows with their sums if not ranked."""
    wq, wc = weights(w_quality, w_citation)
    stats = rows.agg(*(f(c).alias(f"{n}_{c}") for c in ("quality_score", "citation_count") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))

    def z(c: str) -> Column:
        return F.when(F.col(f"std_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.nullif(F.col(f"std_{c}"), F.lit(0.0))).otherwise(0.0)

    final = F.round(wq * z("quality_score") + wc * z("citation_count"), 10)
    scored = with_scalars(rows, stats).withColumn("final_score", final).drop(*stats.columns)
    if not ranked:
        return scored
    order = [F.desc("final_score"), F.desc("quality_score"), F.desc("citation_count"), *page_order(F.col("page_id"))]
    return _ranked(scored, order, k)


def summary(rows: DataFrame, *columns: str) -> DataFrame:
    """Count, least, median, mean and largest of each column."""
    parts = [F.count("*").alias("n")]
    for c in columns:
        parts += [F.min(c).alias(f"{c}_min"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    out = rows.agg(*parts)
    for c in columns:
        out = with_quantiles(out, quantiles(rows, F.col(c), [0.5]).select(F.get("q", F.lit(0)).alias(f"{c}_median")))
    return out


def ties_at_cutoff(rows: DataFrame, selected: DataFrame, column: str) -> DataFrame:
    """The least selected value of a column, and how many rows have it."""
    cutoff = selected.agg(F.min(column).alias("cutoff"))
    return with_scalars(rows, cutoff).where(F.col(column) == F.col("cutoff")).groupBy("cutoff").agg(F.count("*").alias("ties"))


def overlap(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """How many pages both selections have, and their share of k."""
    shared = one.select("page_id").intersect(two.select("page_id"))
    return shared.agg(F.count("*").alias("overlap"), F.round(F.count("*") / F.lit(float(max(1, k))), 10).alias("overlap_ratio"))


def with_raw_text(selected: DataFrame, texts: DataFrame) -> DataFrame:
    """The first text of each page by ordinal, or an empty one; texts of other pages are filtered before they are grouped."""
    wanted = texts.join(selected.select("page_id").distinct(), "page_id", "left_semi")
    first = wanted.groupBy("page_id").agg(F.min_by("raw_text", "ordinal").alias("raw_text"))
    return selected.join(first, "page_id", "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


def needed_ids(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.select("page_id").union(two.select("page_id")).distinct()


def cutoff_diagnostics(rows: DataFrame, share: float, column: str = "quality_score") -> DataFrame:
    """Quartiles, the score at rank round(share x n), and how many are above, and at or above it; scores are never null."""
    scores = rows.select(F.col(column).cast("double").alias("score"))
    counts = value_counts(scores, F.col("score"))
    top = F.greatest(F.lit(1), F.floor(F.sum("_n") * share + 0.5))
    groups = counts.agg(F.array((F.sum("_n") - top).cast("long")).alias("_ranks"), top.cast("long").alias("top_n"))
    cutoff = with_quantiles(groups, values_at(counts, groups.select("_ranks"))).select("top_n", F.get("_at", F.lit(0)).alias("cutoff"))
    stats = with_scalars(scores, cutoff).agg(
        F.count("*").alias("n"),
        F.min("score").alias("min"),
        F.round(F.avg("score"), 8).alias("mean"),
        F.max("score").alias("max"),
        F.max("top_n").alias("top_n"),
        F.max("cutoff").alias("cutoff"),
        F.count_if(F.col("score") > F.col("cutoff")).alias("above"),
        F.count_if(F.col("score") >= F.col("cutoff")).alias("at_or_above"),
    )
    quartiles = quantiles(scores, F.col("score"), [0.25, 0.5, 0.75]).select(*(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    return with_quantiles(stats, quartiles)


def raw_text_hits(selected: DataFrame) -> DataFrame:
    """How many selected pages have a raw text."""
    return selected.agg(F.count_if(F.col("raw_text") != "").alias("raw_text_found_count"))


def selection_report(articles: DataFrame, one: DataFrame, two: DataFrame, k: int, w_quality: float = 0.7, w_citation: float = 0.3) -> DataFrame:
    """One row: total rows, cutoffs, pool, ties and summaries of both selections (with raw_text), and their overlap.

    Names of the first selection begin with m1_, those of the second with m2_.
    """
    wq, wc = weights(w_quality, w_citation)
    pool = quality_pool(articles, k)
    size = F.lit(float(max(1, k)))
    everything = articles.agg(F.count("*").alias("total_rows"), *(f(c).alias(f"m2_{n}_{s}_all") for n, c in (("quality", "quality_score"), ("citation", "citation_count")) for s, f in (("mean", F.avg), ("std", F.stddev_pop))))
    parts = [pool.agg(F.min("quality_score").alias("m1_quality_cutoff"), F.count("*").alias("m1_quality_pool_size"))]
    parts.append(ties_at_cutoff(pool, one, "citation_count").agg(F.first("cutoff").alias("m1_citation_cutoff_in_selected"), F.first("ties").alias("m1_citation_ties_at_cutoff_in_pool")))
    scored = by_weighted_z(articles, k, w_quality, w_citation, ranked=False)
    parts.append(ties_at_cutoff(scored, two, "final_score").agg(F.first("cutoff").alias("m2_final_score_cutoff"), F.first("ties").alias("m2_final_score_ties_at_cutoff")))
    for prefix, chosen, columns in (("m1", one, ("quality", "citation")), ("m2", two, ("quality", "citation", "final"))):
        source = {"quality": "quality_score", "citation": "citation_count", "final": "final_score"}
        stats = summary(chosen, *(source[c] for c in columns))
        parts.append(stats.select(*(F.col(f"{source[c]}_{s}").alias(f"{prefix}_selected_{c}_{s}") for c in columns for s in ("mean", "median"))))
        found = raw_text_hits(chosen)
        parts.append(found.select(F.col("raw_text_found_count").alias(f"{prefix}_raw_text_found_count"), (F.col("raw_text_found_count") / size).alias(f"{prefix}_raw_text_found_ratio")))
    parts.append(overlap(one, two, k).withColumnsRenamed({"overlap": "intersection_count", "overlap_ratio": "intersection_ratio_vs_topk"}))
    for part in parts:
        everything = with_scalars(everything, part)
    return everything.withColumns({"top_k": F.lit(k), "m2_weight_quality_normalized": F.lit(wq), "m2_weight_citation_normalized": F.lit(wc)})


# The lines of the selection report in their order, under the titles of its parts.
REPORT = {
    "": ["total_rows"],
    "Method 1: quality -> citation": [
        "top_k", "m1_quality_cutoff", "m1_quality_pool_size", "m1_citation_cutoff_in_selected", "m1_citation_ties_at_cutoff_in_pool", "m1_selected_quality_mean", "m1_selected_quality_median",
        "m1_selected_citation_mean", "m1_selected_citation_median", "m1_raw_text_found_count", "m1_raw_text_found_ratio",
    ],
    "Method 2: weighted z-score final_score": [
        "top_k", "m2_weight_quality_normalized", "m2_weight_citation_normalized", "m2_quality_mean_all", "m2_quality_std_all", "m2_citation_mean_all", "m2_citation_std_all", "m2_final_score_cutoff",
        "m2_final_score_ties_at_cutoff", "m2_selected_quality_mean", "m2_selected_quality_median", "m2_selected_citation_mean", "m2_selected_citation_median", "m2_selected_final_mean",
        "m2_selected_final_median", "m2_raw_text_found_count", "m2_raw_text_found_ratio",
    ],
    "Overlap": ["intersection_count", "intersection_ratio_vs_topk"],
}
_COUNTS = ("total_rows", "top_k", "_size", "_in_pool", "_ties_at_cutoff", "_count")


def selection_report_text(stats: dict[str, object], **inputs: str) -> str:
    """The report of a row of selection_report(); inputs are named lines after the title."""
    lines = ["Top-k article selection comparison", *(f"{k}: {v}" for k, v in inputs.items())]
    for title, names in REPORT.items():
        lines += ["", title] if title else []
        for name in names:
            value = 0 if stats[name] is None else stats[name]
            lines.append(f"{name.removeprefix('m1_').removeprefix('m2_')}: " + (f"{int(value)}" if name.endswith(_COUNTS) else f"{value:.10f}"))
    return "\n".join(lines) + "\n"


def report(stats: dict[str, object]) -> str:
    """Lines of a text report, floats to 10 places."""
    return "\n".join(f"{k}: {v:.10f}" if isinstance(v, float) else f"{k}: {v}" for k, v in stats.items()) + "\n"
