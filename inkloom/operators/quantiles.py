"""Exact quantiles and order statistics without gathering values.

The `percentile` aggregate keeps all distinct values of a group in one task.
Here values are counted first (distributed, combined before the shuffle), and
approximate quantiles cut them into BUCKETS ranges. Totals of the ranges show in
which one a rank lies, and only those ranges are sorted, each by itself.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import distinct_edges, finite
from .scalars import with_scalars

#: Ranges of values: a power of two, less one for the bounds between them.
BUCKETS = 256
_ACCURACY = 4096


def _attached(left: DataFrame, right: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """left with the other columns of right, which has a row for each group; a null key is a group."""
    if not by:
        return with_scalars(left, right)
    keys = {k: f"_key_{k}" for k in by}
    other = right.withColumnsRenamed(keys)
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(r)) for k, r in keys.items()))
    return left.join(other, met, how).drop(*keys.values())


_CALLS = itertools.count(1)


def value_counts(rows: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """by, _v, _n: how often each value that is not null occurs in its group.

    The last condition always holds. It is another one in each call: Spark would
    merge the scalar subqueries of like calls, and fails where these are nested.
    """
    counts = rows.select(*by, value.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > -next(_CALLS))


def values_at(counts: DataFrame, groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, _at: the values at ranks (from 0) of groups, an array in their order; groups has by and _ranks, and counts is of value_counts()."""
    cuts = F.array(*(F.lit(i / BUCKETS) for i in range(1, BUCKETS)))
    bounds = counts.groupBy(*by).agg(F.percentile_approx("_v", cuts, _ACCURACY).alias("_bounds"))
    binned = _attached(counts, bounds, by).withColumn("_bucket", F.lit(0))
    step = BUCKETS // 2
    while step:  # a binary search: how many bounds are at or below the value
        binned = binned.withColumn("_bucket", F.col("_bucket") + F.when(F.col("_v") >= F.get("_bounds", F.col("_bucket") + (step - 1)), step).otherwise(0))
        step //= 2
    binned = binned.drop("_bounds")
    totals = binned.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_total"))
    # BUCKETS rows for each group
    placed = totals.withColumn("_before", F.sum("_total").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_total"))
    wanted = _attached(placed, groups, by).where(F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_total")))).drop("_total")
    keys = (*by, "_bucket")
    some = _attached(binned, wanted, keys)
    begin = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v")) - F.col("_n")
    held = some.withColumn("_begin", begin).select(*by, "_v", F.posexplode(F.transform("_ranks", lambda r: (r >= F.col("_begin")) & (r < F.col("_begin") + F.col("_n")))).alias("_i", "_here")).where("_here")
    return held.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_at"))


def quantiles(rows: DataFrame, value: Column, shares: list[float], by: tuple[str, ...] = (), name: str = "q") -> DataFrame:
    """by, name: the linearly interpolated quantiles of a value, an array; without values it is null.

    Without by it is one row, which is computed at once: left to the plan, each
    step that builds on quantiles of the last one would repeat all before it.
    """
    counts = value_counts(rows, value, by)
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_size"))
    place = [F.col("_size") - 1 if s == 1 else (F.col("_size") - 1) * F.lit(float(s)) for s in shares]
    ranks = F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil)))
    groups = sizes.select(*by, ranks.alias("_ranks"))
    found = _attached(sizes, values_at(counts, groups, by), by, "left")

    def between(i: int, p: Column) -> Column:
        low, high = F.get("_at", F.lit(2 * i)), F.get("_at", F.lit(2 * i + 1))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    out = found.select(*by, F.when(F.size("_at") > 0, F.array(*(between(i, p) for i, p in enumerate(place)))).alias(name))
    return out if by else rows.sparkSession.createDataFrame([tuple(out.first())], f"{name} array<double>")


def with_quantiles(stats: DataFrame, found: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """stats, a row for each group, with the columns of found beside them."""
    return _attached(stats, found, by, "left")


def quantile_edges(rows: DataFrame, column: str, bins: int, name: str = "edges") -> DataFrame:
    """One row with name: the bin edges at i / bins of a column's finite values; fewer than one bin counts as one."""
    bins = max(1, bins)
    value = F.when(finite(F.col(column)), F.col(column).cast("double"))
    return quantiles(rows, value, [i / bins for i in range(bins + 1)]).select(distinct_edges(F.col("q")).alias(name))
