"""Curation of labelled texts: duplicates, filters, bins, splits and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import digitize, finite, ratio
from ..functions.text import collapse_whitespace, word_count
from .quantiles import quantile_edges, quantiles, value_counts, values_at, with_quantiles
from .scalars import with_scalars


def first_of_pairs(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The first row of each (text, label) by ordinal; null texts go, and rows with a null label are never duplicates."""
    known = rows.where("text is not null")
    rest = [c for c in rows.columns if c not in ("text", "label")]
    labelled = known.where("label is not null").groupBy("text", "label").agg(F.min_by(F.struct(*rest), ordinal).alias("first"))
    out = labelled.select("text", "label", "first.*").select(*rows.columns)
    return out.unionByName(known.where("label is null"))


def by_length_percentiles(rows: DataFrame, lower: float = 0.05, upper: float = 0.95, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with a word count between the percentiles, both included; a row of cutoffs and counts)."""
    counted = rows.withColumn("n_words", word_count(text))
    cutoffs = quantiles(counted, F.col("n_words"), [lower, upper]).select(F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))
    judged = with_scalars(counted, cutoffs)
    kept = judged.where(F.col("n_words").between(F.col("lower"), F.col("upper"))).drop("lower", "upper")
    report = judged.agg(
        F.max("lower").alias("lower"),
        F.max("upper").alias("upper"),
        F.count_if(F.col("n_words") < F.col("lower")).alias("too_short"),
        F.count_if(F.col("n_words") > F.col("upper")).alias("too_long"),
        F.count_if(F.col("n_words").between(F.col("lower"), F.col("upper"))).alias("kept"),
    )
    return kept, report


def valid_perplexity(column: Column) -> Column:
    return finite(column) & (column > 0)


def by_perplexity_cutoff(rows: DataFrame, column: str = "perplexity_score") -> tuple[DataFrame, DataFrame]:
    """(rows at or below min(p90, q3 + 1.5 iqr) of the valid values; a row of the cutoff and counts)."""
    value = F.when(valid_perplexity(F.col(column)), F.col(column))
    q = quantiles(rows, value, [0.25, 0.75, 0.9])
    fence = F.get("q", F.lit(1)) + 1.5 * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))
    cutoffs = q.select(fence.alias("upper_fence"), F.get("q", F.lit(2)).alias("p90"), F.least(F.get("q", F.lit(2)), fence).alias("cutoff"))
    judged = with_scalars(rows, cutoffs)
    valid = valid_perplexity(F.col(column))
    kept = judged.where(valid & (F.col(column) <= F.col("cutoff"))).drop(*cutoffs.columns)
    report = judged.agg(
        F.max("upper_fence").alias("upper_fence"),
        F.max("p90").alias("p90"),
        F.max("cutoff").alias("cutoff"),
        F.count_if(F.coalesce(valid, F.lit(False)) & (F.col(column) <= F.col("cutoff"))).alias("kept"),
        F.count_if(F.coalesce(valid, F.lit(False)) & (F.col(column) > F.col("cutoff"))).alias("removed_above"),
        F.count_if(~F.coalesce(valid, F.lit(False))).alias("removed_invalid"),
    )
    return kept, report


def with_bins(rows: DataFrame, column: str, bins: int, name: str, edges_from: DataFrame | None = None) -> DataFrame:
    """rows with <name>: the quantile bin of a column, by the edges of another frame if given."""
    edges = quantile_edges(edges_from if edges_from is not None else rows, column, bins, "_edges")
    return with_scalars(rows, edges).withColumn(name, digitize(F.col(column).cast("double"), F.col("_edges"))).drop("_edges")


def stratum(label: str = "label", length_bin: str = "len_bin", perplexity_bin: str = "ppl_bin") -> Column:
    return F.concat_ws("__", F.col(label).cast("string"), F.concat(F.lit("len"), F.col(length_bin)), F.concat(F.lit("ppl"), F.col(perplexity_bin)))


def stratified_split(rows: DataFrame, key: Column, stratum_: Column, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42, least: int = 2) -> DataFrame:
    """rows with `split`: train, val or test.

    In each stratum rows are in the order of a hash of the seed and their key,
    and a row's place decides; quotas of strata add up by running totals over
    the strata, so that the whole split is within a row of its shares. Strata
    with fewer than `least` rows are trained on. Only hashes are ranked: the
    hashes at which a stratum's parts begin are joined to the rows, which are
    not shuffled.
    """
    train, val = shares
    # 52 bits of the hash are exact in a double
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 13), 16, 10).cast("double")
    hashed = rows.withColumns({"_stratum": stratum_, "_hash": place})
    counts = value_counts(hashed, F.col("_hash"), ("_stratum",))
    sizes = counts.groupBy("_stratum").agg(F.sum("_n").alias("_size"))
    small = F.col("_size") < least
    # a row for each stratum: labels times bins
    order = Window.orderBy("_stratum")
    upto = F.sum(F.when(small, 0).otherwise(F.col("_size"))).over(order)
    before = upto - F.when(small, 0).otherwise(F.col("_size"))
    quota = lambda share: F.floor(upto * share + 0.5) - F.floor(before * share + 0.5)
    quotas = sizes.select("_stratum", "_size", F.when(small, F.col("_size")).otherwise(quota(train)).alias("_train"), F.when(small, 0).otherwise(quota(val)).alias("_val"))
    last = F.col("_size") - 1
    ranks = F.array(F.least("_train", last), F.least(F.col("_train") + F.col("_val"), last)).cast("array<bigint>")
    begins = with_quantiles(quotas, values_at(counts, quotas.select("_stratum", ranks.alias("_ranks")), ("_stratum",)), ("_stratum",))
    # a part that no row begins starts beyond all hashes
    part = lambda i, n: F.when(n >= F.col("_size"), float("inf")).otherwise(F.get("_at", F.lit(i)))
    begins = begins.select("_stratum", part(0, F.col("_train")).alias("_val_from"), part(1, F.col("_train") + F.col("_val")).alias("_test_from"))
    split = F.when(F.col("_hash") < F.col("_val_from"), "train").when(F.col("_hash") < F.col("_test_from"), "val").otherwise("test")
    joined = with_quantiles(hashed, begins, ("_stratum",))
    return joined.withColumn("split", split).withColumn("stratum", F.col("_stratum")).drop("_stratum", "_hash", "_val_from", "_test_from")


def split_report(split: DataFrame, label: str = "label") -> DataFrame:
    """Counts by label, bins and stratum of each split and overall, in one pass of grouping sets."""
    keys = F.array(
        F.concat(F.lit("label="), F.col(label).cast("string")),
        F.concat(F.lit("len="), F.col("len_bin").cast("string")),
        F.concat(F.lit("ppl="), F.col("ppl_bin").cast("string")),
        F.concat(F.lit("stratum="), F.col("stratum")),
    )
    long = split.select(F.explode(F.array(F.col("split"), F.lit("overall"))).alias("split"), keys.alias("keys")).select("split", F.explode("keys").alias("key"))
    return long.groupBy("split", "key").agg(F.count("*").alias("n"))


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of the seed and a key: the same in every run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """Count and share of each label; the window is over one row per label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 10))


def class_ratio(rows: DataFrame, label: str = "label") -> DataFrame:
    ones, zeros = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return rows.agg(ones.alias("class1"), zeros.alias("class0"), F.round(ones / F.greatest(zeros, F.lit(1)), 10).alias("class1_to_class0"))


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def described(rows: DataFrame, column: str, *by: str, shares: dict[str, float] = QUARTILES) -> DataFrame:
    """count, min, the quantiles of shares, mean, max, population std of a column."""
    value = F.col(column).cast("double")
    parts = [F.count(value).alias("n"), F.min(value).alias("min"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max"), F.round(F.stddev_pop(value), 6).alias("std")]
    stats = rows.groupBy(*by).agg(*parts) if by else rows.agg(*parts)
    found = quantiles(rows, value, list(shares.values()), by)
    named = [F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(shares)]
    return with_quantiles(stats, found, by).select(*by, "n", "min", *named, "mean", "max", "std")


PROFILE = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def profiled(rows: DataFrame, dataset: str, perplexity: str = "perplexity_score", length: str = "n_words") -> DataFrame:
    """dataset, metric and the profile of the valid perplexities and of the word counts: a row for each metric."""
    value = F.when(valid_perplexity(F.col(perplexity)), F.col(perplexity))
    one = described(rows.select(value.alias("v")), "v", shares=PROFILE).withColumn("metric", F.lit("perplexity"))
    two = described(rows.select(F.col(length).alias("v")), "v", shares=PROFILE).withColumn("metric", F.lit("word_length"))
    return one.unionByName(two).withColumn("dataset", F.lit(dataset))


def invalid_counts(rows: DataFrame, dataset: str, perplexity: str = "perplexity_score") -> DataFrame:
    """Rows and why their perplexities are not valid: missing, NaN, infinite, or not above 0."""
    value = F.col(perplexity)
    infinite, nan = F.abs(value) == float("inf"), F.isnan(value)
    counts = {"rows_loaded": F.count("*"), "missing": F.count_if(value.isNull()), "nan": F.count_if(nan), "inf": F.count_if(infinite), "non_positive": F.count_if(finite(value) & (value <= 0)), "valid": F.count_if(valid_perplexity(value))}
    return rows.agg(*(c.alias(n) for n, c in counts.items())).withColumn("dataset", F.lit(dataset))


def class_cutoffs(rows: DataFrame, dataset: str, label: str = "label", perplexity: str = "perplexity_score", length: str = "n_words") -> DataFrame:
    """dataset, metric, label, cutoff: the 95th percentile of valid perplexities and the 99th of word counts of each class."""
    value = F.when(valid_perplexity(F.col(perplexity)), F.col(perplexity))
    parts = [(quantiles(rows, value, [0.95], (label,)), "perplexity"), (quantiles(rows, F.col(length), [0.99], (label,)), "word_length")]
    frames = [q.select(F.lit(dataset).alias("dataset"), F.lit(m).alias("metric"), F.col(label), F.round(F.get("q", F.lit(0)), 6).alias("cutoff")) for q, m in parts]
    return frames[0].unionByName(frames[1])


def quality_flags(rows: DataFrame, label: str = "label", short: int = 10, long: int = 500) -> DataFrame:
    """Markup, short, long and duplicate counts of cleaned texts.

    Texts are replaced by 128-bit digests and their flags before the shuffle;
    copies are then grouped with partial sums.
    """
    clean = rows.select(collapse_whitespace("text").alias("text"), F.col(label).alias("label")).where("text <> ''")
    short_rows = clean.select(F.md5("text").alias("digest"), "label", F.char_length("text").alias("size"), F.col("text").rlike("<[^>]+>").alias("markup"))
    pairs = short_rows.groupBy("digest", "label").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("markup").alias("markup"))
    texts = pairs.groupBy("digest").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.first("size").alias("size"), F.first("markup").alias("markup"))
    size = F.col("size")
    flagged = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    out = texts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicate_text"),
        F.coalesce(F.sum(F.col("n") - F.col("labels")), F.lit(0)).alias("n_duplicate_text_label"),
        flagged(size < short).alias("n_short_text"),
        flagged(size > long).alias("n_long_text"),
        flagged(F.col("markup")).alias("n_has_markup"),
    )
    n = F.greatest("n_records", F.lit(1))
    return out.withColumns({"pct_duplicate_text": F.round(F.col("n_duplicate_text") / n, 10), "pct_has_markup": F.round(F.col("n_has_markup") / n, 10)})


# The bounds of the length buckets.
LENGTH_BOUNDS = (0, 50, 100, 150, 200, 300, 500, 10_000)


def length_buckets(rows: DataFrame, label: str = "label", length: str = "char_len") -> DataFrame:
    """Counts and row percentages of labels 0 and 1 in length buckets, empty ones included; longer texts are in none."""
    n = F.col(length)
    bucket = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(LENGTH_BOUNDS, LENGTH_BOUNDS[1:])):
        bucket = F.when((n > a if i else n >= a) & (n <= b), i).otherwise(bucket)
    counts = rows.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.count_if(F.col(label) == 0).alias("class0"), F.count_if(F.col(label) == 1).alias("class1"))
    frame = rows.sparkSession.range(len(LENGTH_BOUNDS) - 1).select(F.col("id").cast("int").alias("bucket"))
    filled = frame.join(F.broadcast(counts), "bucket", "left").fillna(0, ["class0", "class1"])  # a row for each bucket
    total = F.col("class0") + F.col("class1")
    return filled.withColumns({f"pct{i}": F.round(ratio(F.col(f"class{i}"), total) * 100, 2) for i in (0, 1)})


def extremes(rows: DataFrame, column: str, key: str, k: int = 10) -> DataFrame:
    """The k smallest and k largest rows of a column, by two top-k operators."""
    low = rows.orderBy(F.asc(column), key).limit(k).withColumn("side", F.lit("smallest"))
    return low.unionAll(rows.orderBy(F.desc(column), key).limit(k).withColumn("side", F.lit("largest")))
