"""One query per operator over the TPC-H-like tables and `events`, each with its SQL.

The tables are first seen as labelled arrays: E1, events along time; E2, sums per
day and type (E2M: with every fourth cell missing); L3, prices per month and
flag; O1, order totals by key; M, the matrix of embeddings.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Lattice, apply_named
from .functions.elementwise import rounded_away
from .operators import exact
from .plans import halos

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

E2_SQL = "e2 AS (SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"
E2M_SQL = f"{E2_SQL}, p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pd, dense_rank() OVER (ORDER BY event_type) - 1 AS pt FROM e2), m AS (SELECT day, event_type, n, pd, pt, CASE WHEN (pd + pt) % 4 <> 0 THEN v END AS v FROM p)"
L3_SQL = "l3 AS (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, l_returnflag, sum(l_extendedprice) AS price, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)"
E1M_SQL = "e AS (SELECT ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)"
BY = "PARTITION BY event_type ORDER BY pd"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e1(spark: SparkSession, d: str, masked: bool = False) -> Lattice:
    v = F.when(F.col("event_id") % 7 != 0, F.col("value")) if masked else F.col("value")
    return Lattice.from_frame(read(spark, d, "events").select("ts", v.alias("v")), ["ts"], ["v"], check=False)


def e2(spark: SparkSession, d: str, masked: bool = False, variables: tuple[str, ...] = ("v",)) -> Lattice:
    cells = read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    cube = Lattice.from_frame(cells, ["day", "event_type"], variables, check=False)
    return cube.apply(lambda c: F.when((F.col("__pos_day") + F.col("__pos_event_type")) % 4 != 0, c)) if masked else cube


def l3(spark: SparkSession, d: str, *variables: str) -> Lattice:
    cells = read(spark, d, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), "l_returnflag").agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))
    return Lattice.from_frame(cells, ["month", "l_returnflag"], variables or ("price", "quantity"), check=False)


def o1(spark: SparkSession, d: str) -> Lattice:
    return Lattice.from_frame(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], ["o_totalprice"], check=False)


def steps(spark: SparkSession, d: str, step: float) -> DataFrame:
    """Labels 0, step, 2 * step, ... up to the largest order key."""
    top = read(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return spark.range(int(top // step) + 1).select((F.col("id") * step).alias("x"))


def matrix(spark: SparkSession, d: str) -> Lattice:
    """Features count from 0; both coordinates are dense, so positions need no search."""
    cells = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "x")).select("vec_id", F.col("feature").cast("long").alias("feature"), F.col("x").cast("double").alias("x"))
    return Lattice.from_frame(cells, ["vec_id", "feature"], ["x"], check=False)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def out(x: Lattice, digits: int = 4, name: str | None = None) -> DataFrame:
    """Rows without positions, floats rounded."""
    df = x.to_table(name)
    return df.select(*(rounded_away(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# -- reductions -----------------------------------------------------------------


def _reduction(name: str, run: Callable[[Lattice], Lattice], sql: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return out(run(e2(spark, d, masked=True)))

    fn.__name__ = name
    query(f"WITH {E2M_SQL} SELECT event_type, {sql} AS v FROM m GROUP BY event_type")(fn)


_reduction("reduce_sum", lambda x: x.sum("day"), "round(coalesce(sum(v), 0), 4)")
_reduction("reduce_mean", lambda x: x.mean("day"), "round(avg(v), 4)")
_reduction("reduce_min", lambda x: x.min("day"), "round(min(v), 4)")
_reduction("reduce_max", lambda x: x.max("day"), "round(max(v), 4)")
_reduction("reduce_var", lambda x: x.var("day"), "round(var_pop(v), 4)")
_reduction("reduce_std_ddof1", lambda x: x.std("day", ddof=1), "round(stddev_samp(v), 4)")
_reduction("reduce_count", lambda x: x.count("day"), "count(v)")
_reduction("reduce_first", lambda x: x.first("day"), "round(arg_min(v, pd) FILTER (WHERE v IS NOT NULL), 4)")
_reduction("reduce_last", lambda x: x.last("day"), "round(arg_max(v, pd) FILTER (WHERE v IS NOT NULL), 4)")
_reduction("reduce_median", lambda x: x.median("day"), "round(median(v), 4)")
_reduction("reduce_min_count", lambda x: x.sum("day", min_count=23), "round(CASE WHEN count(v) >= 23 THEN sum(v) END, 4)")
_reduction("reduce_skipna_false", lambda x: x.mean("day", skipna=False), "round(CASE WHEN count(v) = count(*) THEN avg(v) END, 4)")
_reduction("reduce_any", lambda x: (x > 5000.0).any("day"), "bool_or(coalesce(v > 5000, false))")
_reduction("reduce_all", lambda x: (x > 100.0).all("day"), "bool_and(coalesce(v > 100, false))")


@query(f"WITH {E2_SQL} SELECT event_type, CAST(product(n % 3 + 1) AS BIGINT) AS n FROM e2 GROUP BY event_type")
def reduce_prod_bounded(spark: SparkSession, d: str) -> DataFrame:
    return out((e2(spark, d, variables=("n",)) % 3 + 1).prod("day"))


@query(f"WITH {E2M_SQL}, q AS (SELECT event_type, unnest([0.1, 0.5, 0.9])::DOUBLE AS quantile, unnest(quantile_cont(v, [0.1, 0.5, 0.9])) AS v FROM m GROUP BY event_type) SELECT quantile, event_type, round(v, 4) AS v FROM q")
def reduce_quantile(spark: SparkSession, d: str) -> DataFrame:
    return out(e2(spark, d, masked=True).quantile([0.1, 0.5, 0.9], "day"))


@query(f"WITH {L3_SQL} SELECT round(avg(price), 4) AS price, round(avg(quantity), 4) AS quantity FROM l3")
def reduce_all_dims(spark: SparkSession, d: str) -> DataFrame:
    return out(l3(spark, d).mean())


# -- groups and time --------------------------------------------------------------


def _grouped(op: str, sql: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return out(getattr(e2(spark, d, masked=True).groupby("day", F.dayofweek, "weekday"), op)())

    fn.__name__ = f"groupby_{op}"
    query(f"WITH {E2M_SQL} SELECT CAST(dayofweek(day) + 1 AS INTEGER) AS weekday, event_type, {sql} AS v FROM m GROUP BY 1, 2")(fn)


_grouped("sum", "round(coalesce(sum(v), 0), 4)")
_grouped("mean", "round(avg(v), 4)")
_grouped("count", "count(v)")
_grouped("min", "round(min(v), 4)")
_grouped("max", "round(max(v), 4)")


def _resampled(name: str, freq: str, op: str, label: str, value: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return out(getattr(e1(spark, d, masked=True).resample("ts", freq), op)())

    fn.__name__ = name
    query(f"WITH {E1M_SQL}, a AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS o FROM e) SELECT {label} AS ts, {value} AS v FROM e, a GROUP BY 1")(fn)


_resampled("resample_6h_mean", "6h", "mean", "time_bucket(INTERVAL 6 HOUR, ts, o)", "round(avg(v), 4)")
_resampled("resample_2d_sum", "2D", "sum", "time_bucket(INTERVAL 2 DAY, ts, o)", "round(coalesce(sum(v), 0), 4)")
_resampled("resample_week_mean", "W", "mean", "(date_trunc('week', ts) + INTERVAL 6 DAY)::TIMESTAMP", "round(avg(v), 4)")
_resampled("resample_month_count", "MS", "count", "date_trunc('month', ts)::TIMESTAMP", "count(v)")
_resampled("resample_month_end_max", "ME", "max", "last_day(ts)::TIMESTAMP", "max(v)")


def _weights(spark: SparkSession, d: str) -> Lattice:
    days = read(spark, d, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return Lattice.from_frame(days.select("day", F.dayofmonth("day").cast("double").alias("w")), ["day"], ["w"], check=False)


@query(f"WITH {E2M_SQL} SELECT event_type, round(sum(v * day(day)) / sum(CASE WHEN v IS NOT NULL THEN day(day) END), 4) AS v FROM m GROUP BY 1")
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return out(e2(spark, d, masked=True).weighted(_weights(spark, d)).mean("day"))


@query(f"WITH {E2M_SQL} SELECT event_type, round(sum(v * day(day)), 4) AS v FROM m GROUP BY 1")
def weighted_sum(spark: SparkSession, d: str) -> DataFrame:
    return out(e2(spark, d, masked=True).weighted(_weights(spark, d)).sum("day"))


@query(f"WITH {E2M_SQL} SELECT event_type, round(sum(CASE WHEN v IS NOT NULL THEN day(day) ELSE 0 END)::DOUBLE, 4) AS v FROM m GROUP BY 1")
def weighted_sum_of_weights(spark: SparkSession, d: str) -> DataFrame:
    return out(e2(spark, d, masked=True).weighted(_weights(spark, d)).sum_of_weights("day"))


# -- windows ----------------------------------------------------------------------


def _cube_window(name: str, run: Callable[[Lattice], Lattice], sql: str, digits: int = 4) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return out(run(e2(spark, d, masked=True)), digits)

    fn.__name__ = name
    query(f"WITH {E2M_SQL} {sql}")(fn)


def _framed(value: str, frame: str, need: int, digits: int = 4) -> str:
    w = f"OVER ({BY} ROWS BETWEEN {frame})"
    return f"SELECT day, event_type, round(CASE WHEN count(v) {w} >= {need} THEN {value} {w} END, {digits}) AS v FROM m"


@query(f"WITH {E2_SQL}, p AS (SELECT *, count(*) OVER w AS c, avg(v) OVER w AS a FROM e2 WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT day, event_type, round(CASE WHEN c >= 3 THEN a END, 4) AS v FROM p")
def rolling_mean_centered(spark: SparkSession, d: str) -> DataFrame:
    return out(e2(spark, d).rolling("day", 3).mean())


_cube_window("rolling_sum_trailing", lambda x: x.rolling("day", 4, center=False).sum(), _framed("sum(v)", "3 PRECEDING AND CURRENT ROW", 4))
_cube_window("rolling_min_periods", lambda x: x.rolling("day", 5, min_periods=2).mean(), _framed("avg(v)", "2 PRECEDING AND 2 FOLLOWING", 2))
_cube_window("rolling_max_even", lambda x: x.rolling("day", 4, min_periods=1).max(), _framed("max(v)", "2 PRECEDING AND 1 FOLLOWING", 1))
_cube_window("rolling_count", lambda x: x.rolling("day", 3).count(), f"SELECT day, event_type, (count(v) OVER ({BY} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))::DOUBLE AS v FROM m")


@query("WITH w AS (SELECT ts, count(value) OVER o AS c, stddev_pop(value) OVER o AS s FROM events WINDOW o AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT ts, round(CASE WHEN c >= 5 THEN s END, 4) AS v FROM w")
def rolling_std(spark: SparkSession, d: str) -> DataFrame:
    return out(e1(spark, d).rolling("ts", 5).std())


@query("WITH x AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT avg(o_orderkey) AS o_orderkey, round(avg(o_totalprice), 4) AS o_totalprice FROM x WHERE i < n - n % 7 GROUP BY i // 7")
def coarsen_trim(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).coarsen_reduce("o_orderkey", 7, "mean", boundary="trim"))


@query("WITH x AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT avg(o_orderkey) AS o_orderkey, round(sum(o_totalprice), 2) AS o_totalprice FROM x GROUP BY i // 7")
def coarsen_pad(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).coarsen_reduce("o_orderkey", 7, "sum", boundary="pad"), 2).withColumn("o_orderkey", F.col("o_orderkey"))


# -- scans and stencils -------------------------------------------------------------

_cube_window("cumsum", lambda x: x.cumsum("day"), f"SELECT day, event_type, round(coalesce(sum(v) OVER ({BY} ROWS UNBOUNDED PRECEDING), 0), 4) AS v FROM m")
_cube_window("cumsum_skipna_false", lambda x: x.cumsum("day", skipna=False), f"SELECT day, event_type, round(CASE WHEN count(v) OVER w = count(*) OVER w THEN sum(v) OVER w END, 4) AS v FROM m WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)")
_cube_window("cumprod", lambda x: (x / 100000.0 + 1.0).cumprod("day"), f"SELECT day, event_type, round(coalesce(product(v / 100000 + 1) OVER ({BY} ROWS UNBOUNDED PRECEDING), 1), 4) AS v FROM m")
_cube_window("diff_upper", lambda x: x.diff("day"), f"SELECT day, event_type, round(x, 4) AS v FROM (SELECT *, v - lag(v) OVER ({BY}) AS x FROM m) WHERE pd >= 1")
_cube_window("diff2_lower", lambda x: x.diff("day", 2, label="lower"), f"SELECT day, event_type, round(x, 4) AS v FROM (SELECT *, (lead(v, 2) OVER ({BY}) - lead(v) OVER ({BY})) - (lead(v) OVER ({BY}) - v) AS x, max(pd) OVER () AS last FROM m) WHERE pd <= last - 2")
_cube_window("shift", lambda x: x.shift("day", 2), f"SELECT day, event_type, round(lag(v, 2) OVER ({BY}), 4) AS v FROM m")
_cube_window("shift_fill", lambda x: x.shift("day", -1, fill_value=0.0), f"SELECT day, event_type, round(CASE WHEN pd = max(pd) OVER () THEN 0 ELSE lead(v) OVER ({BY}) END, 4) AS v FROM m")
_cube_window("roll", lambda x: x.roll("day", 3), "SELECT a.day, a.event_type, round(b.v, 4) AS v FROM m a JOIN m b ON a.event_type = b.event_type AND b.pd = (a.pd - 3 + (SELECT max(pd) + 1 FROM m)) % (SELECT max(pd) + 1 FROM m)")
_cube_window("pad_constant", lambda x: x.pad("day", (1, 2), constant_values=-1.0), "SELECT day, event_type, round(v, 4) AS v FROM m UNION ALL SELECT NULL, event_type, -1.0 FROM (SELECT DISTINCT event_type FROM m), range(3)")
_cube_window("ffill", lambda x: x.ffill("day"), f"SELECT day, event_type, round(last_value(v IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), 4) AS v FROM m")
_cube_window("ffill_limit", lambda x: x.where(x > 4000.0).ffill("day", limit=2), f"SELECT day, event_type, round(last_value(CASE WHEN v > 4000 THEN v END IGNORE NULLS) OVER ({BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS v FROM m")
_cube_window("bfill", lambda x: x.bfill("day"), f"SELECT day, event_type, round(first_value(v IGNORE NULLS) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS v FROM m")

_HOURS = "epoch_us(ts) / 3600000000.0"


@query(
    f"WITH x AS (SELECT ts, value AS f, {_HOURS} AS h, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM events), y AS (SELECT *, lag(f) OVER o AS fb, lead(f) OVER o AS fa, h - lag(h) OVER o AS hs, lead(h) OVER o - h AS hd FROM x WINDOW o AS (ORDER BY ts)) "
    "SELECT ts, round(CASE WHEN i = 1 THEN (fa - f) / hd WHEN i = n THEN (f - fb) / hs ELSE (hs * hs * fa + (hd * hd - hs * hs) * f - hd * hd * fb) / (hs * hd * (hd + hs)) END, 2) AS v FROM y"
)
def differentiate(spark: SparkSession, d: str) -> DataFrame:
    return out(e1(spark, d).differentiate("ts", datetime_unit="h", nan=True), 2)


@query(
    "WITH t AS (SELECT i * 2.5 AS x FROM range(0, (SELECT CAST(floor(max(o_orderkey) / 2.5) AS BIGINT) + 1 FROM orders)) r(i)), o AS (SELECT o_orderkey::DOUBLE AS k, o_totalprice AS v FROM orders), lo AS (SELECT t.x, o.k, o.v FROM t ASOF LEFT JOIN o ON t.x >= o.k), hi AS (SELECT t.x, o.k, o.v FROM t ASOF LEFT JOIN o ON t.x <= o.k) "
    "SELECT lo.x AS o_orderkey, round(CASE WHEN lo.k = hi.k THEN lo.v ELSE lo.v + (hi.v - lo.v) * ((lo.x - lo.k) / (hi.k - lo.k)) END, 3) AS o_totalprice FROM lo JOIN hi USING (x)"
)
def interp_linear(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).assign_coords(o_orderkey=lambda c: c.cast("double")).interp("o_orderkey", steps(spark, d, 2.5)), 3)


# -- elementwise ---------------------------------------------------------------------


def _prices(name: str, run: Callable[[Lattice], Lattice], sql: str, digits: int = 4) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return out(run(o1(spark, d)), digits)

    fn.__name__ = name
    query(f"SELECT o_orderkey, {sql} AS o_totalprice FROM orders")(fn)


_prices("arith", lambda x: (x * 2 + 1) / 3 - 0.5, "round((o_totalprice * 2 + 1) / 3 - 0.5, 4)")
_prices("floordiv_mod", lambda x: (x - 100000.0) // 7.0 + (x - 100000.0) % 7.0, "round(floor((o_totalprice - 100000) / 7) + (o_totalprice - 100000 - 7 * floor((o_totalprice - 100000) / 7)), 3)", 3)
_prices("divide_by_zero", lambda x: 1.0 / (x.round(-5) - 100000.0), "CASE WHEN d = 0 THEN 'inf'::DOUBLE ELSE round(1.0 / d, 4) END".replace("d = 0", "round_even(o_totalprice, -5) - 100000 = 0").replace("1.0 / d", "1.0 / (round_even(o_totalprice, -5) - 100000)"), 4)
_prices("where_other", lambda x: x.where(x > 150000.0, -1.0), "round(CASE WHEN o_totalprice > 150000 THEN o_totalprice ELSE -1 END, 4)")
_prices("ufunc_exp_log", lambda x: np.exp(np.log(x) / 2) + np.sqrt(x) + np.hypot(x, 3.0), "round(exp(ln(o_totalprice) / 2) + sqrt(o_totalprice) + sqrt(o_totalprice * o_totalprice + 9), 4)")
_prices("clip_round", lambda x: (x / 1000).clip(50.0, 200.0).round(1), "round_even(least(greatest(o_totalprice / 1000, 50), 200), 1)", 4)
_prices("evaluate_expr", lambda x: x.evaluate("(o_totalprice - 1000) * k + -o_totalprice / 4", k=3), "round((o_totalprice - 1000) * 3 + -o_totalprice / 4, 4)")
_cube_window("compare_null", lambda x: x != 0.0, "SELECT day, event_type, coalesce(v <> 0, true) AS v FROM m")
_cube_window("fillna_isnull", lambda x: x.fillna(0.0).where(x.isnull(), 1.0), "SELECT day, event_type, CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END AS v FROM m")


@query(f"WITH {L3_SQL} SELECT month, l_returnflag, round(price / quantity, 4) AS price FROM l3")
def combine_same_origin(spark: SparkSession, d: str) -> DataFrame:
    x = l3(spark, d)
    return out(x["price"] / x["quantity"])


@query(f"WITH {L3_SQL}, a AS (SELECT l_returnflag, avg(price) AS p FROM l3 GROUP BY 1) SELECT month, l_returnflag, round(price - p, 3) AS price FROM l3 JOIN a USING (l_returnflag)")
def broadcast_anomaly(spark: SparkSession, d: str) -> DataFrame:
    x = l3(spark, d, "price")
    return out(x - x.mean("month"), 3)


# -- indexing ------------------------------------------------------------------------

_cube_window("isel_slice", lambda x: x.isel(day=slice(3, 20, 2)), "SELECT day, event_type, round(v, 4) AS v FROM m WHERE pd >= 3 AND pd < 20 AND (pd - 3) % 2 = 0")
_cube_window("isel_scalar", lambda x: x.isel(day=-1), "SELECT event_type, round(v, 4) AS v FROM m WHERE pd = (SELECT max(pd) FROM m)")
_cube_window("isel_list", lambda x: x.isel(day=[5, 0, 5]), "SELECT day, event_type, round(v, 4) AS v FROM m JOIN (SELECT unnest([5, 0, 5]) AS pd) USING (pd)")


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def sel_slice(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).sel(o_orderkey=slice(100, 5000)))


@query("SELECT round(arg_min(value, abs(epoch_us(ts) - epoch_us(t.m))), 4) AS v FROM events, (SELECT date_trunc('day', min(ts)) + INTERVAL 36 HOUR AS m FROM events) t")
def sel_nearest(spark: SparkSession, d: str) -> DataFrame:
    x = e1(spark, d)
    first = read(spark, d, "events").agg(F.min("ts")).first()[0]
    return out(x.sel(ts=dt.datetime.combine(first.date(), dt.time()) + dt.timedelta(hours=36), method="nearest"))


@query("SELECT x AS o_orderkey, round(coalesce(o_totalprice, CASE WHEN o_orderkey IS NULL THEN -1 END), 4) AS o_totalprice FROM (SELECT i * 7 AS x FROM range(0, (SELECT max(o_orderkey) // 7 + 1 FROM orders)) r(i)) LEFT JOIN orders ON x = o_orderkey")
def reindex_fill(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).reindex(o_orderkey=steps(spark, d, 7), fill_value=-1.0))


@query("SELECT x AS o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM (SELECT i * 7 AS x FROM range(0, (SELECT max(o_orderkey) // 7 + 1 FROM orders)) r(i)) t ASOF LEFT JOIN orders o ON t.x >= o.o_orderkey")
def reindex_ffill(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).reindex(o_orderkey=steps(spark, d, 7), method="ffill"))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS place FROM orders")
def sortby_desc(spark: SparkSession, d: str) -> DataFrame:
    x = o1(spark, d)
    df = x.sortby(x, ascending=False).frame()
    return df.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), F.col("__pos_o_orderkey").alias("place"))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey DESC LIMIT 10")
def topk(spark: SparkSession, d: str) -> DataFrame:
    x = o1(spark, d)
    return out(x.largest("o_orderkey", x, 10))


@query(f"WITH {E2_SQL} SELECT day, event_type, round(v / n, 4) AS v FROM e2")
def align_inner(spark: SparkSession, d: str) -> DataFrame:
    """Two arrays of different origin with equal labels."""
    a, b = e2(spark, d).align(e2(spark, d, variables=("n",)))
    return out(a / b)


# -- linear algebra, exactness, blocks -------------------------------------------------


@query("WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings) SELECT a.f AS feature, b.f AS feature_2, round(sum(a.x * b.x), 3) AS x FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2")
def matmul_gram(spark: SparkSession, d: str) -> DataFrame:
    x = matrix(spark, d)
    return out(x.matmul(x.rename_dims({"feature": "feature_2"})), 3)


@query("WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings), m AS (SELECT f, avg(x) AS y FROM c GROUP BY 1) SELECT vec_id, round(sum(x * y), 4) AS x FROM c JOIN m USING (f) GROUP BY 1")
def matmul_vec(spark: SparkSession, d: str) -> DataFrame:
    x = matrix(spark, d)
    return out(x @ x.mean("vec_id"))


@query("SELECT event_type, round(sum(value), 6) AS total FROM events GROUP BY 1")
def repro_sum(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_sum(read(spark, d, "events"), "value", ["event_type"], "total").withColumn("total", F.round("total", 6))


@query("SELECT o_orderstatus, round(product(1 + o_totalprice / 1e10), 6) AS p FROM orders GROUP BY 1")
def repro_prod(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "orders").withColumn("x", 1 + F.col("o_totalprice") / 1e10)
    return exact.exact_product(df, "x", ["o_orderstatus"], "p").withColumn("p", F.round("p", 6))


@query("SELECT event_type, CAST((sum(user_id) % 18446744073709551616) AS BIGINT) AS checksum FROM events GROUP BY 1")
def checksum_int(spark: SparkSession, d: str) -> DataFrame:
    return exact.checksum(read(spark, d, "events"), "user_id", ["event_type"])


@query("SELECT event_type, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616 ELSE s END AS BIGINT) AS checksum FROM (SELECT event_type, ((sum(CAST(CAST(value AS BIT) AS BIGINT)) % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS s FROM events GROUP BY 1)")
def checksum(spark: SparkSession, d: str) -> DataFrame:
    return exact.checksum(read(spark, d, "events"), "value", ["event_type"])


@query(
    f"WITH {E2M_SQL}, n AS (SELECT max(pd) + 1 AS n FROM m), b AS (SELECT i AS block, i * (n // 4) + least(i, n % 4) AS a, (i + 1) * (n // 4) + least(i + 1, n % 4) AS z FROM range(4) r(i), n) "
    "SELECT block, day, event_type, round(v, 4) AS v, NOT (pd >= a AND pd < z) AS halo FROM m JOIN b ON pd >= a - 2 AND pd < z + 1"
)
def halo_update(spark: SparkSession, d: str) -> DataFrame:
    return e2(spark, d, masked=True).halo("day", 2, 1, blocks=4).select("block", "day", "event_type", F.round("v", 4).alias("v"), "halo")


@query(
    f"WITH {E2M_SQL}, n AS (SELECT max(pd) + 1 AS n FROM m), b AS (SELECT i AS block, i * (n // 4) + least(i, n % 4) AS a, (i + 1) * (n // 4) + least(i + 1, n % 4) AS z FROM range(4) r(i), n) "
    "SELECT block, day, event_type, round(v, 4) AS v FROM m JOIN b ON pd = a OR pd = z - 1"
)
def block_boundary(spark: SparkSession, d: str) -> DataFrame:
    x = e2(spark, d, masked=True)
    return halos.boundary(x.frame(), "day", x.sizes["day"], 4).select("block", "day", "event_type", F.round("v", 4).alias("v"))


@query(
    f"WITH {E2M_SQL}, s AS (SELECT max(pd) + 1 AS nd, max(pt) + 1 AS nt FROM m) SELECT pd AS y, pt AS x, round(v, 4) AS v FROM m UNION ALL SELECT 2 * nd - 1 - pd, nt - 1 - pt, round(-v, 4) FROM m, s WHERE pd >= nd - 2"
)
def fold_north(spark: SparkSession, d: str) -> DataFrame:
    x = e2(spark, d, masked=True)
    df = halos.fold(x.frame(), ["v"], "day", "event_type", x.sizes, 2, "north", -1)
    return df.select(F.col("__pos_day").alias("y"), F.col("__pos_event_type").alias("x"), F.round("v", 4).alias("v"))


@query(f"WITH {E2M_SQL} SELECT day, event_type, round(greatest(v, 3000), 4) AS v FROM m WHERE v IS NOT NULL UNION ALL SELECT day, event_type, NULL FROM m WHERE v IS NULL")
def ufunc_maximum(spark: SparkSession, d: str) -> DataFrame:
    return out(apply_named("maximum", e2(spark, d, masked=True), 3000.0))


# -- more of the above: methods, schema edits, storage --------------------------------


def _asof(name: str, method: str, sql: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return out(o1(spark, d).isel(o_orderkey=slice(0, None, 3)).reindex(o_orderkey=steps(spark, d, 7), method=method))

    fn.__name__ = name
    query(
        "WITH o AS (SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 3 = 0), t AS (SELECT i * 7 AS x FROM range(0, (SELECT max(o_orderkey) // 7 + 1 FROM orders)) r(i)), "
        "lo AS (SELECT t.x, o.o_orderkey AS k, o.o_totalprice AS v FROM t ASOF LEFT JOIN o ON t.x >= o.o_orderkey), hi AS (SELECT t.x, o.o_orderkey AS k, o.o_totalprice AS v FROM t ASOF LEFT JOIN o ON t.x <= o.o_orderkey) "
        f"SELECT lo.x AS o_orderkey, round({sql}, 4) AS o_totalprice FROM lo JOIN hi USING (x)"
    )(fn)


_asof("reindex_bfill", "bfill", "hi.v")
_asof("reindex_nearest", "nearest", "CASE WHEN lo.k IS NULL OR hi.k - lo.x <= lo.x - lo.k THEN hi.v ELSE lo.v END")


@query(
    "WITH t AS (SELECT i * 2.5 AS x FROM range(0, (SELECT CAST(floor(max(o_orderkey) / 2.5) AS BIGINT) + 1 FROM orders)) r(i)), o AS (SELECT o_orderkey::DOUBLE AS k, o_totalprice AS v FROM orders), lo AS (SELECT t.x, o.k, o.v FROM t ASOF LEFT JOIN o ON t.x >= o.k), hi AS (SELECT t.x, o.k, o.v FROM t ASOF LEFT JOIN o ON t.x <= o.k) "
    "SELECT lo.x AS o_orderkey, round(CASE WHEN lo.k IS NULL OR hi.k IS NULL THEN NULL WHEN lo.x - lo.k <= hi.k - lo.x THEN lo.v ELSE hi.v END, 3) AS o_totalprice FROM lo JOIN hi USING (x)"
)
def interp_nearest(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).assign_coords(o_orderkey=lambda c: c.cast("double")).interp("o_orderkey", steps(spark, d, 2.5), "nearest"), 3)


def _polynomial(name: str, method: str, power: int) -> None:
    """Splines through a polynomial of their own degree are that polynomial."""

    def fn(spark: SparkSession, d: str) -> DataFrame:
        x = o1(spark, d).assign_coords(o_orderkey=lambda c: c / 1000.0)
        curve = x.apply(lambda c: F.pow(F.col("o_orderkey"), F.lit(power)) - 2 * F.col("o_orderkey"))
        return out(curve.interp("o_orderkey", steps(spark, d, 40).select((F.col("x") / 1000.0).alias("x")), method), 3)

    fn.__name__ = name
    query(
        "WITH e AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders) SELECT i * 40 / 1000.0::DOUBLE AS o_orderkey, "
        f"round(CASE WHEN i * 40 BETWEEN a AND b THEN pow(i * 40 / 1000.0::DOUBLE, {power}) - 2 * (i * 40 / 1000.0::DOUBLE) END, 3) AS o_totalprice FROM e, range(0, (SELECT max(o_orderkey) // 40 + 1 FROM orders)) r(i)"
    )(fn)


_polynomial("interp_quadratic", "quadratic", 2)
_polynomial("interp_cubic", "cubic", 3)


def _chosen(name: str, run: Callable[[Lattice], Lattice], where: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return out(run(o1(spark, d)))

    fn.__name__ = name
    query(f"SELECT round(o_totalprice, 4) AS o_totalprice FROM orders WHERE {where}")(fn)


_chosen("sel_exact", lambda x: x.sel(o_orderkey=100), "o_orderkey = 100")
_chosen("sel_pad", lambda x: x.sel(o_orderkey=1_000_000_000, method="pad"), "o_orderkey = (SELECT max(o_orderkey) FROM orders)")
_chosen("sel_backfill", lambda x: x.sel(o_orderkey=-5, method="bfill", tolerance=1_000_000), "o_orderkey = (SELECT min(o_orderkey) FROM orders)")


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM (SELECT *, count(*) OVER () - row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i % 4 = 0")
def isel_reversed(spark: SparkSession, d: str) -> DataFrame:
    return out(o1(spark, d).isel(o_orderkey=slice(None, None, -4)))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_totalprice > 250000")
def where_drop(spark: SparkSession, d: str) -> DataFrame:
    x = o1(spark, d)
    return out(x.where(x > 250000.0, drop=True))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, row_number() OVER (ORDER BY round_even(o_totalprice, -4), o_orderkey) - 1 AS place FROM orders")
def sortby_two_keys(spark: SparkSession, d: str) -> DataFrame:
    x = o1(spark, d)
    df = x.sortby([x.round(-4), "o_orderkey"]).frame()
    return df.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), F.col("__pos_o_orderkey").alias("place"))


_prices("power_root", lambda x: x**0.5 + 2.0 ** (x / 100000.0), "round(pow(o_totalprice, 0.5) + pow(2, o_totalprice / 100000), 4)")
_prices("unary_abs", lambda x: abs(-x + 100000.0) - +x, "round(abs(100000 - o_totalprice) - o_totalprice, 4)")
_prices("astype_int", lambda x: np.floor(x / 7).astype("bigint") * 3, "CAST(floor(o_totalprice / 7) AS BIGINT) * 3")
_prices("bit_operations", lambda x: ((x / 100).astype("bigint") & 255) ^ ((x / 100).astype("bigint") << 2) | 1, "xor(CAST(trunc(o_totalprice / 100) AS BIGINT) & 255, CAST(trunc(o_totalprice / 100) AS BIGINT) << 2) | 1")
_prices("logic", lambda x: ((x > 100000.0) & ~(x > 200000.0)) | (x < 50000.0), "((o_totalprice > 100000 AND NOT o_totalprice > 200000) OR o_totalprice < 50000)")
_prices("ufunc_trigonometry", lambda x: np.sin(x) + np.cos(x) * np.arctan2(x, 2.0) + np.tanh(x / 1e6) + np.deg2rad(x / 1e4), "round(sin(o_totalprice) + cos(o_totalprice) * atan2(o_totalprice, 2) + tanh(o_totalprice / 1e6) + radians(o_totalprice / 1e4), 4)")
_prices("ufunc_logarithms", lambda x: np.log1p(x) + np.log2(x) + np.log10(x) + np.cbrt(x) + np.expm1(x / 1e6) + np.sign(x - 150000.0), "round(ln(1 + o_totalprice) + log2(o_totalprice) + log10(o_totalprice) + cbrt(o_totalprice) + exp(o_totalprice / 1e6) - 1 + sign(o_totalprice - 150000), 4)")
_prices("apply_function", lambda x: x.apply(lambda c, y, k: c + y * k, x / 2, 3.0), "round(o_totalprice + o_totalprice / 2 * 3, 4)")
_prices("cyclic_roll_back", lambda x: x.roll("o_orderkey", 5).roll("o_orderkey", -5), "round(o_totalprice, 4)")

_cube_window("raw_operand", lambda x: x * np.arange(x.sizes["event_type"], dtype=float), "SELECT day, event_type, round(v * pt, 4) AS v FROM m")
_cube_window("rolling_median", lambda x: x.rolling_reduce("day", 3, "median", min_periods=1), f"SELECT day, event_type, round(median(v) OVER ({BY} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS v FROM m")
_cube_window("rolling_min", lambda x: x.rolling("day", 3, min_periods=1).min(), f"SELECT day, event_type, round(min(v) OVER ({BY} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS v FROM m")
_cube_window("schema_edits", lambda x: x.rename({"day": "date", "v": "amount"}).transpose("event_type", "date").rename({"date": "day"}).rename_vars({"amount": "v"}).expand_dims("run").isel(run=0), "SELECT day, event_type, round(v, 4) AS v FROM m")
_cube_window("assign_labels", lambda x: x.assign_coords(event_type=lambda c: F.upper(c)), "SELECT day, upper(event_type) AS event_type, round(v, 4) AS v FROM m")
_cube_window("bfill_limit", lambda x: x.bfill("day", limit=1), f"SELECT day, event_type, round(first_value(v IGNORE NULLS) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 4) AS v FROM m")
_cube_window("coarsen_trim_max", lambda x: x.coarsen_reduce("day", 4, "max", boundary="trim", coord_func="first"), "SELECT min(day) AS day, event_type, round(max(v), 4) AS v FROM m WHERE pd < (SELECT (max(pd) + 1) // 4 * 4 FROM m) GROUP BY pd // 4, event_type")
_cube_window("global_order", lambda x: Lattice.from_frame(halos.global_field(x.isel(event_type=0).frame(), "day", x.sizes["day"]).select("day", "v"), ["day"], ["v"]), "SELECT day, round(v, 4) AS v FROM m WHERE pt = 0")
_resampled("resample_quarter_sum", "QS", "sum", "date_trunc('quarter', ts)::TIMESTAMP", "round(coalesce(sum(v), 0), 4)")
_resampled("resample_year_end_min", "YE", "min", "(date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::TIMESTAMP", "min(v)")


@query("WITH e AS (SELECT ts, value AS v FROM events WHERE dayofweek(ts) NOT IN (0, 3)), a AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS o, max(ts) AS z FROM e), g AS (SELECT unnest(generate_series(o, z, INTERVAL 1 DAY)) AS ts FROM a) SELECT g.ts, count(e.v) AS v FROM g LEFT JOIN e ON date_trunc('day', e.ts) = g.ts GROUP BY 1")
def resample_fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").where(~F.dayofweek("ts").isin(1, 4)).select("ts", F.col("value").alias("v"))
    return out(Lattice.from_frame(rows, ["ts"], ["v"], check=False).resample("ts", "1D", fill_gaps=True).count())


@query(f"WITH {E2_SQL}, l AS (SELECT *, n % 3 AS g FROM e2 WHERE event_type = 'click'), x AS (SELECT e2.day, e2.event_type, e2.v, l.g FROM e2 JOIN l USING (day)) SELECT CAST(g AS BIGINT) AS kind, event_type, round(sum(v), 3) AS v FROM x GROUP BY 1, 2")
def groupby_variable(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the values of another array along the same dimension."""
    kind = e2(spark, d, variables=("n",)).sel(event_type="click") % 3
    return out(e2(spark, d).groupby("day", kind, "kind").sum(), 3)


@query("SELECT i AS t, j AS y, CAST(i * 10 + j AS DOUBLE) AS v FROM range(0, 1000) r(i), range(0, 7) s(j)")
def from_fill_function(spark: SparkSession, d: str) -> DataFrame:
    from .sources import from_fill

    return out(from_fill(spark, lambda a, b: np.arange(a, b)[:, None] * 10.0 + np.arange(7), ["t", "y"], [1000, 7], blocks=8))


def _stored(name: str, write: str) -> None:
    def fn(spark: SparkSession, d: str) -> DataFrame:
        from .plans.storage import shared_path
        from .sources import netcdf, store

        x, path = e2(spark, d, masked=True).assign_coords(event_type=lambda c: F.ascii(c).cast("long")), shared_path(spark, name)
        if write == "store":
            x.isel(day=slice(0, 20)).to_store(path, unlimited=["day"])
            store.append(x.isel(day=slice(20, None)), path, "day")
            return out(store.read(spark, path))
        at = x.assign_coords(day=lambda c: c.cast("timestamp_ntz"))
        at.isel(day=slice(0, 20)).to_netcdf(f"{path}.nc", unlimited_dim="day")
        netcdf.append(at.isel(day=slice(20, None)), f"{path}.nc", "day")
        return out(netcdf.open_dataset(spark, f"{path}.nc"))

    fn.__name__ = name
    day = "day" if write == "store" else "day::TIMESTAMP AS day"
    query(f"WITH {E2M_SQL} SELECT {day}, CAST(ascii(event_type) AS BIGINT) AS event_type, round(v, 4) AS v FROM m")(fn)


_stored("store_append", "store")
_stored("netcdf_append", "netcdf")


@query(
    f"WITH {E2M_SQL}, n AS (SELECT max(pd) + 1 AS n, max(pt) + 1 AS k FROM m), b AS (SELECT i AS bd, j AS bt, i * (n // 3) + least(i, n % 3) AS a, (i + 1) * (n // 3) + least(i + 1, n % 3) AS z, j * (k // 2) + least(j, k % 2) AS c, (j + 1) * (k // 2) + least(j + 1, k % 2) AS y FROM range(3) r(i), range(2) s(j), n) "
    "SELECT bd, bt, day, event_type, round(v, 4) AS v, NOT (pd >= a AND pd < z AND pt >= c AND pt < y) AS halo FROM m JOIN b ON pd >= a - 1 AND pd < z + 1 AND pt >= c - 1 AND pt < y + 1"
)
def halo_corners(spark: SparkSession, d: str) -> DataFrame:
    rows = e2(spark, d, masked=True).halo(["day", "event_type"], 1, 1, blocks=[3, 2])
    return rows.select(F.col("block.day").alias("bd"), F.col("block.event_type").alias("bt"), "day", "event_type", F.round("v", 4).alias("v"), "halo")


@query(f"WITH {E2_SQL} SELECT day, event_type, round(v + v / 2, 3) AS v FROM e2")
def fold_fields(spark: SparkSession, d: str) -> DataFrame:
    x = e2(spark, d)
    return halos.fold_fields([x.frame(), (x / 2).frame()], ["day", "event_type"], ["v"]).withColumn("v", F.round("v", 3))


@query(f"WITH {E2_SQL}, n AS (SELECT count(DISTINCT day) AS n FROM e2), p AS (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pd FROM e2), b AS (SELECT i AS block, i * (n // 2) + least(i, n % 2) AS a, (i + 1) * (n // 2) + least(i + 1, n % 2) AS z FROM range(2) r(i), n) SELECT block, day, event_type, round(v, 3) AS v, n FROM p JOIN b ON pd >= a - 1 AND pd < z + 1")
def halo_group(spark: SparkSession, d: str) -> DataFrame:
    """Two fields in one exchange."""
    a, b = e2(spark, d), e2(spark, d, variables=("n",))
    keys = ["__pos_day", "day", "__pos_event_type", "event_type"]
    return halos.update_group([a.frame(), b.frame()], keys, "day", a.sizes["day"], 2, 1, 1).select("block", "day", "event_type", F.round("v", 3).alias("v"), "n")


@query(f"WITH {E2_SQL} SELECT round(sum(v), 4) AS v FROM e2")
def global_sum_exact(spark: SparkSession, d: str) -> DataFrame:
    return out(e2(spark, d).exact_sum())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event cube, three-day centred mean per type."""
    return rolling_mean_centered(spark, sf_dir)
