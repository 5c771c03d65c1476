"""Every catalogue query against its SQL in DuckDB, on the smallest tables, and the entry points."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__
from cellweave import catalogue

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 2)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return dt.datetime.combine(value, dt.time())
    return value


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.collect()]
    cursor = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=0.011) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_shuffle_of_unneeded_columns(spark):
    """Filters and columns reach the scan, and aggregates combine before the exchange."""
    df = catalogue.e1(spark, SF).isel(ts=slice(0, 5)).frame()
    plan = catalogue.QUERIES["reduce_all_dims"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in plan
    assert "partial_sum" in plan and df.count() == 5
    stored = catalogue.o1(spark, SF).sel(o_orderkey=slice(10, 20)).frame()
    assert stored.count() > 0
