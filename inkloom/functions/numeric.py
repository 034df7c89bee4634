"""Numeric functions: decay, quantile edges, bins, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decay(distance: Column, scheme: str = "S2", alpha: float = 7.0) -> Column:
    """Review probability at a distance from an edit."""
    floor = max(alpha, 1e-12)
    if scheme == "S1":
        return F.exp(-distance / F.lit(floor))
    if scheme == "S2":
        return 1 / (F.greatest(distance - F.lit(alpha), F.lit(0.0)) + 1)
    if scheme == "S3":
        return 1 / (1 + F.pow(distance / F.lit(floor), 2))
    raise ValueError(f"unknown decay scheme {scheme}")


def noisy_or(probabilities: Column) -> Column:
    """Probability of at least one of independent events, of an array."""
    return 1 - F.aggregate(probabilities, F.lit(1.0), lambda acc, p: acc * (1 - p))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def distinct_edges(quantiles: Column) -> Column:
    """Bin edges from an array of quantiles: the distinct ones in order; a single one x gives x - 1 and x + 1, and null 0 and 1."""
    edges = F.array_sort(F.array_distinct(quantiles))
    single = F.array(F.get(edges, F.lit(0)) - 1, F.get(edges, F.lit(0)) + 1)
    return F.when(quantiles.isNull(), F.array(F.lit(0.0), F.lit(1.0))).when(F.size(edges) < 2, single).otherwise(edges)


def digitize(value: Column, edges: Column) -> Column:
    """Bin of a finite value: the number of inner edges at or below it; null for others."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(finite(value), F.size(F.filter(inner, lambda e: e <= value)))


def predicted_class(logits: Column) -> Column:
    """Class of an array of logits: the first largest, or for one logit whether its sigmoid is above one half."""
    return F.when(F.size(logits) == 1, (F.get(logits, F.lit(0)) > 0).cast("int")).otherwise((F.array_position(logits, F.array_max(logits)) - 1).cast("int"))
