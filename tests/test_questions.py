"""Questions against an independent engine, and the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from measured.plans import bricks, constructs, figures, questions

ALL = questions.QUERIES | bricks.QUERIES | constructs.QUERIES | figures.QUERIES
SQL = questions.SQL | bricks.SQL | constructs.SQL | figures.SQL


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ALL))
def test_same_rows(spark, small, duck, name):
    df = ALL[name](spark, small)
    want = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    rows = lambda found, names: sorted(repr([dict(zip(names, r, strict=True))[c] for c in order]) for r in found)
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["nation", "orders_n", "customers", "newest"]
    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_pushed_filters(spark, small):
    plan = ALL["q01_orders_per_day"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan
