"""Values of one-row frames beside other rows, as scalar subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a frame that has a single row (a global aggregate).

    The row is a scalar subquery: it is computed once, before rows are scanned,
    and takes no join.
    """
    value = one.select(F.struct(*one.columns).alias("_one")).scalar()
    return rows.withColumn("_one", value).select(*rows.columns, "_one.*")
