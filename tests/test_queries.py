"""Each query of the catalogue against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from inkloom.plans import queries as catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(tidy(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sql, name):
    frame = catalogue.QUERIES[name](spark, SF)
    want = sql.sql(catalogue.SQL[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert rows(frame.columns, frame.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_is_the_flagship_query(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= catalogue.K
    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql())
