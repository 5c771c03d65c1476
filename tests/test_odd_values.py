"""Queries against their SQL in DuckDB bit by bit, on tables with repeated times, zeros and infinities."""

import duckdb
import numpy as np
import pytest

from cellweave import catalogue
from cellweave.plans.windows import Layout
from cellweave.sources.build import from_numpy

#: Seconds and values of events: equal ones in the middle and at the end.
EVENTS = [(0, 1.0), (60, 2.0), (60, 2.0), (60, 2.0), (200, 5.0), (300, None), (420, 4.0), (500, 4.5), (640, 4.0), (900, 7.0), (900, 7.0)]


def equal(spark, folder, table, name, select):
    """Rows as text, in which NaN, a missing value and both zeros differ."""
    c = duckdb.connect()
    c.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = c.execute(catalogue.SQL[name]).fetchall()
    df = catalogue.QUERIES[name](spark, str(folder))
    order = [d[0] for d in c.execute(catalogue.SQL[name]).description]
    got = [tuple(r[k] for k in order) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return [r[-1] for r in got]


def test_differentiate_repeated_times(spark, tmp_path):
    rows = ", ".join(f"({i}, {t}, {'NULL' if v is None else v})" for i, (t, v) in enumerate(EVENTS))
    values = equal(spark, tmp_path, "events", "differentiate", f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(t) AS ts, v::DOUBLE AS value FROM (VALUES {rows}) x(i, t, v)")
    assert sum(v is None for v in values) == 3 and sum(v is not None and np.isnan(v) for v in values) == 5


@pytest.mark.parametrize("layout", [Layout(), Layout(block=3, groups=64)], ids=["plain", "blocks"])
@pytest.mark.parametrize("order", [1, 2])
def test_differentiate_repeated_labels(spark, layout, order):
    """Different values at one label give signed infinities."""
    t = np.array([0.0, 0.0, 1.0, 3.0, 3.0, 4.0, 6.0, 6.0, 6.0])
    x = np.array([2.0, 1.0, 5.0, 2.0, 4.0, 3.0, 3.0, 3.0, 1.0])
    with np.errstate(all="ignore"):
        hs, hd = (t[1:-1] - t[:-2]), (t[2:] - t[1:-1])
        inner = (hs * hs * x[2:] + (hd * hd - hs * hs) * x[1:-1] - hd * hd * x[:-2]) / (hs * hd * (hd + hs))
        ends = np.gradient(x, t, edge_order=order)
    want = np.r_[ends[0], inner, ends[-1]]
    assert np.isinf(want).sum() >= 3
    made = from_numpy(spark, x, ["t"], coords={"t": t.tolist()}, layout=layout)
    np.testing.assert_array_equal(made.differentiate("t", order).to_numpy(), want)
    told = {p: v for p, v in made.differentiate("t", order, nan=True).frame().select("__pos_t", "v").collect()}
    np.testing.assert_array_equal([told[i] for i in range(len(t))], want)


def test_divide_by_zero_signs(spark, tmp_path):
    """What rounds to zero keeps its sign."""
    prices = ["0.0", "-0.0", "49999.99", "50000.0", "50000.01", "100000.0", "149999.99", "150000.0", "150000.01", "250000.0", "450000.0", "-60000.0", "1e300", "'inf'::DOUBLE", "'-inf'::DOUBLE", "NULL"]
    rows = ", ".join(f"({i}, ({p})::DOUBLE)" for i, p in enumerate(prices))
    values = equal(spark, tmp_path, "orders", "divide_by_zero", f"SELECT i AS o_orderkey, p AS o_totalprice FROM (VALUES {rows}) x(i, p)")
    assert sum(v is not None and np.signbit(v) for v in values) == 6 and values.count(np.inf) == 3
