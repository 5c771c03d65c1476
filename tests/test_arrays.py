"""Array semantics against NumPy, on plain and on blocked layouts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import Lattice, Layout, apply_named
from cellweave.sources import from_fill, from_numpy
from cellweave.sources.build import from_dict

RNG = np.random.default_rng(1)
T, Y = 17, 3
X = RNG.normal(size=(T, Y))
N = np.where(RNG.random((T, Y)) < 0.25, np.nan, X)
N[:, 0] = np.nan
LABELS = np.arange(T) ** 1.3
BLOCKED = Layout(block=4, groups=1000)


def arr(spark, a, layout=Layout(), name="v", labels=LABELS, partitions=None):
    return from_numpy(spark, a, ["t", "y"][: a.ndim], coords={"t": labels.tolist()} if labels is not None and a.shape[0] == len(labels) else None, name=name, layout=layout, partitions=partitions)


def same(x, want, tol=1e-9):
    got = x.to_numpy()
    want = np.asarray(want)
    assert got.shape == want.shape
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=tol, atol=tol)


@pytest.fixture(scope="module", params=[None, BLOCKED], ids=["plain", "blocks"])
def layout(request):
    return request.param or Layout()


def test_round_trip(spark):
    same(arr(spark, N), N)
    assert arr(spark, N).sizes == {"t": T, "y": Y}


@pytest.mark.parametrize("op", ["sum", "prod", "mean", "min", "max", "var", "std"])
def test_reductions(spark, op):
    with np.errstate(all="ignore"), np.testing.suppress_warnings() as s:
        s.filter(RuntimeWarning)
        want = getattr(np, f"nan{op}")
        same(getattr(arr(spark, N), op)("t"), want(N, axis=0))
        same(getattr(arr(spark, N), op)("t", skipna=False), getattr(np, op)(N, axis=0))
        same(getattr(arr(spark, N), op)(), want(N))


def test_reduction_details(spark):
    x = arr(spark, N)
    same(x.sum("t", min_count=T), np.full(Y, np.nan))
    same(x.std("t", ddof=2)["v"], np.nanstd(N, axis=0, ddof=2))
    first = [next((v for v in N[:, j] if not np.isnan(v)), np.nan) for j in range(Y)]
    last = [next((v for v in N[::-1, j] if not np.isnan(v)), np.nan) for j in range(Y)]
    same(x.first("t"), first)
    same(x.last("t"), last)
    same(x.first("t", skipna=False), N[0])
    with np.testing.suppress_warnings() as s:
        s.filter(RuntimeWarning)
        same(x.median("t"), np.nanmedian(N, axis=0))
        same(x.quantile([0.1, 0.9], "t"), np.nanquantile(N, [0.1, 0.9], axis=0))
        for method in ("lower", "higher", "midpoint", "nearest"):
            same(arr(spark, X).quantile(0.3, "t", method=method), np.quantile(X, 0.3, axis=0, method=method))
    same((x > 0).any("t"), (N > 0).any(axis=0))
    same((x != 0).all(), True)
    ints = arr(spark, (X * 10).astype(np.int64))
    assert ints.sum().to_numpy().dtype == np.int64
    same(ints.mean("y"), (X * 10).astype(int).mean(axis=1))
    with pytest.raises(TypeError):
        x.first(["t"])
    with pytest.raises(ValueError):
        x.sum("z")


def test_arithmetic(spark):
    a, b = arr(spark, X), arr(spark, N)
    i, j = (X * 10).astype(np.int64), (RNG.normal(size=(T, Y)) * 3).astype(np.int64)
    p, q = arr(spark, i), arr(spark, j)
    same(a + b * 2 - 1, X + N * 2 - 1)
    same(-abs(a) ** 2, -(np.abs(X) ** 2))
    with np.errstate(all="ignore"):
        same(p // q, i // j)
        same(p % q, np.where(j == 0, 0, i % np.where(j == 0, 1, j)))
        same(a // 0.3, X // 0.3)
        same(a % -0.3, X % -0.3)
        z = np.where(np.abs(X) < 0.5, 0.0, X)
        same(1 / arr(spark, z), 1 / z)
        same(np.log(abs(a)), np.log(np.abs(X)))
        same(np.sqrt(a), np.sqrt(X))
    same(b < 0, N < 0)
    same(b != 0.5, N != 0.5)
    same((a > 0) & (b > 0), (X > 0) & (N > 0))
    same(~(a > 0) | (a < -1), ~(X > 0) | (X < -1))
    same(p & q, i & j)
    same(apply_named("fmax", a, b), np.fmax(X, N))
    same(np.maximum(a, b), np.maximum(X, N))
    same(a.where(b > 0), np.where(N > 0, X, np.nan))
    same(a.where(b > 0, 9.0), np.where(N > 0, X, 9.0))
    same(a.where(b > 0, p), np.where(N > 0, X, i))
    same(b.fillna(0.0).clip(-0.5, 0.5).round(1), np.round(np.clip(np.nan_to_num(N), -0.5, 0.5), 1))
    same(b.isnull(), np.isnan(N))
    same(a - a.mean("t"), X - X.mean(axis=0))
    same(a.evaluate("v * k + -v / 2 ** 2", k=3), X * 3 - X / 4)
    with pytest.raises(ValueError):
        a.evaluate("f(v)")
    with pytest.raises(ValueError):
        a.evaluate("0 < v < 1")
    with pytest.raises(NameError):
        a.evaluate("v + w")
    with pytest.raises(TypeError):
        a.evaluate("v and v")
    with pytest.raises(ValueError):
        bool(a)
    with pytest.raises(ValueError):
        a + arr(spark, X, labels=LABELS + 1)


def test_scans(spark, layout):
    x = arr(spark, N, layout)
    z = np.nan_to_num(N)
    same(x.cumsum("t"), z.cumsum(axis=0))
    same(x.cumsum("t", skipna=False), N.cumsum(axis=0))
    same(x.cumprod("t"), np.where(np.isnan(N), 1, N).cumprod(axis=0))
    same(arr(spark, X, layout).diff("t", 2), np.diff(X, 2, axis=0))
    same(x.diff("t", label="lower"), np.diff(N, axis=0))
    for k in (2, -3, 0, 40):
        want = np.full_like(N, 7.0)
        if 0 <= k < T:
            want[k:] = N[: T - k]
        elif -T < k < 0:
            want[:k] = N[-k:]
        same(x.shift("t", k, fill_value=7.0), want)
        same(x.roll("t", k), np.roll(N, k, axis=0))
    import pandas as pd

    f = pd.DataFrame(N)
    same(x.ffill("t"), f.ffill())
    same(x.bfill("t"), f.bfill())
    same(x.ffill("t", 2), f.ffill(limit=2))
    same(x.bfill("t", 1), f.bfill(limit=1))
    same(x.pad("t", (1, 2), constant_values=3.0), np.pad(N, ((1, 2), (0, 0)), constant_values=3.0))
    for order in (1, 2):
        same(arr(spark, X, layout).differentiate("t", order), np.gradient(X, LABELS, axis=0, edge_order=order), 1e-8)


@pytest.mark.parametrize("window", [1, 3, 4])
def test_rolling(spark, layout, window):
    import pandas as pd

    f = pd.DataFrame(N)
    x = arr(spark, N, layout)
    for op in ("mean", "sum", "min", "max"):
        same(x.rolling_reduce("t", window, op, center=False, min_periods=1), getattr(f.rolling(window, min_periods=1), op)())
        before = window // 2
        after = window - 1 - before
        padded = np.vstack([np.full((before, Y), np.nan), N, np.full((after, Y), np.nan)])
        want = getattr(pd.DataFrame(padded).rolling(window), op)().to_numpy()[window - 1 :]
        same(getattr(x.rolling("t", window), op)(), want)


def test_coarsen(spark):
    x = arr(spark, X)
    same(x.coarsen_reduce("t", 4, "mean", boundary="trim"), X[:16].reshape(4, 4, Y).mean(axis=1))
    assert x.coarsen_reduce("t", 4, "sum", boundary="pad").sizes["t"] == 5
    same(x.coarsen_reduce("t", 4, "max", boundary="trim", side="right"), X[1:].reshape(4, 4, Y).max(axis=1))
    with pytest.raises(ValueError):
        x.coarsen_reduce("t", 4)


def test_indexing(spark):
    x = arr(spark, X)
    same(x.isel(t=slice(2, 9, 3)), X[2:9:3])
    same(x.isel(t=slice(None, None, -2)), X[::-2])
    same(x.isel(t=-1), X[-1])
    same(x.isel(t=[3, 1, 3]), X[[3, 1, 3]])
    same(x.sel(t=slice(2.0, 20.0)), X[(LABELS >= 2) & (LABELS <= 20)])
    same(x.sel(t=float(LABELS[4])), X[4])
    same(x.sel(t=5.0, method="nearest"), X[np.abs(LABELS - 5).argmin()])
    same(x.sel(t=5.0, method="ffill"), X[np.searchsorted(LABELS, 5.0) - 1])
    same(x.sel(t=5.0, method="bfill"), X[np.searchsorted(LABELS, 5.0)])
    with pytest.raises(KeyError):
        x.sel(t=5.0)
    with pytest.raises(KeyError):
        x.sel(t=5.0, method="nearest", tolerance=0.01)
    with pytest.raises(IndexError):
        x.isel(t=T)
    r = x.reindex(t=[float(LABELS[3]), 99.0], fill_value=-1.0)
    same(r, np.vstack([X[3], np.full(Y, -1.0)]))
    key = from_numpy(spark, np.array([2, 1, 2, 1] * 4 + [0]), ["t"], coords={"t": LABELS.tolist()}, name="k")
    k = np.array([2, 1, 2, 1] * 4 + [0])
    same(x.sortby(key), X[np.argsort(k, kind="stable")])
    same(x.sortby(key, ascending=False), X[np.argsort(k, kind="stable")[::-1]])
    same(x.transpose("y", "t").sum("t"), X.sum(axis=0))
    assert x.rename({"v": "w", "t": "time"}).sizes == {"time": T, "y": Y}
    same(x.expand_dims("z").sum("z"), X)


def test_interp(spark):
    x = arr(spark, X)
    t = np.linspace(-1, 45, 13)
    want = np.stack([np.interp(t, LABELS, X[:, j], left=np.nan, right=np.nan) for j in range(Y)], axis=1)
    same(x.interp("t", t.tolist()), want)
    cubic = x.interp("t", LABELS.tolist(), "cubic")
    same(cubic, X, 1e-8)
    q = from_numpy(spark, (LABELS**2)[:, None], ["t", "y"], coords={"t": LABELS.tolist()})
    inside = np.array([1.5, 7.7, 20.1])
    same(q.interp("t", inside.tolist(), "quadratic"), (inside**2)[:, None], 1e-8)


def test_groups_and_time(spark):
    import pandas as pd

    start = dt.datetime(2001, 1, 1, 6)
    times = [start + dt.timedelta(hours=12 * i) for i in range(30)]
    v = RNG.normal(size=(30, 2))
    v[RNG.random((30, 2)) < 0.2] = np.nan
    x = from_numpy(spark, v, ["t", "y"], coords={"t": times})
    f = pd.DataFrame(v, index=pd.DatetimeIndex(times))
    for freq in ("2D", "5D", "6h", "W", "2W", "ME", "MS"):
        for op in ("sum", "mean", "count", "max"):
            want = getattr(f.resample(freq, origin="start_day"), op)()
            some = f.resample(freq, origin="start_day").size() > 0
            got = getattr(x.resample("t", freq), op)()
            same(got, want[some])
            labels = [r[1] for r in got.coordinate("t").orderBy("__pos_t").collect()]
            assert [pd.Timestamp(a) for a in labels] == list(want.index[some]), freq
    g = np.arange(30) % 4
    for op in ("sum", "mean", "min", "count"):
        same(getattr(x.groupby("t", g.tolist()), op)(), getattr(f.groupby(g), op)())
    w = from_numpy(spark, np.abs(RNG.normal(size=30)), ["t"], coords={"t": times}, name="w")
    ww = w.to_numpy()[:, None]
    ok = ~np.isnan(v)
    same(x.weighted(w).mean("t"), np.nansum(v * ww, axis=0) / (ww * ok).sum(axis=0))
    with pytest.raises(ValueError):
        x.resample("t", "-1D")
    assert x.resample("t", "5h", fill_gaps=True).count().sum("t").to_numpy().tolist() == ok.sum(axis=0).tolist()


def test_matmul_and_exact(spark):
    a, b = RNG.normal(size=(6, 5)), RNG.normal(size=(5, 4))
    p, q = from_numpy(spark, a, ["i", "k"]), from_numpy(spark, b, ["k", "j"])
    same(p @ q, a @ b)
    same(from_numpy(spark, a[0], ["k"]) @ q, a[0] @ b)
    import math

    wild = RNG.normal(size=400) * 10.0 ** RNG.integers(-20, 20, 400)
    sums = {from_numpy(spark, wild, ["i"], partitions=n).exact_sum().to_numpy().item() for n in (1, 3, 7)}
    assert len(sums) == 1 and abs(sums.pop() - math.fsum(wild)) <= abs(math.fsum(wild)) * 1e-15
    u = RNG.uniform(0.5, 1.5, 60) * np.where(RNG.random(60) < 0.5, -1, 1)
    prods = {from_numpy(spark, u, ["i"], partitions=n).exact_prod().to_numpy().item() for n in (1, 4)}
    assert len(prods) == 1 and np.isclose(prods.pop(), np.prod(u), rtol=1e-12)
    assert from_numpy(spark, np.arange(1, 13), ["i"]).exact_prod().to_numpy() == 479001600
    bits = int(wild.view(np.int64).sum())
    assert from_numpy(spark, wild, ["i"]).checksum() == bits
    assert from_numpy(spark, a, ["i", "k"]).same_field(from_numpy(spark, a, ["i", "k"], partitions=3))
    assert not from_numpy(spark, a, ["i", "k"]).same_field(from_numpy(spark, a + 1e-12, ["i", "k"]))


def test_sources(spark):
    fill = from_fill(spark, lambda a, b: np.arange(a, b)[:, None] * 10.0 + np.arange(3), ["t", "y"], [11, 3], blocks=4)
    same(fill, np.arange(11)[:, None] * 10.0 + np.arange(3))
    column = from_fill(spark, F.col("__pos_t") * 10.0 + F.col("__pos_y"), ["t", "y"], [11, 3])
    same(column, np.arange(11)[:, None] * 10.0 + np.arange(3))
    both = from_dict(spark, {"a": (["t"], np.arange(4.0)), "b": (["t", "y"], np.ones((4, 2)))}, coords={"t": [1, 2, 3, 4]})
    assert both.variables == {"a": ("t",), "b": ("t", "y")}
    same((both["a"] * both["b"]), np.arange(4.0)[:, None] * np.ones((4, 2)))
    same(both.sum("y")["b"], np.full(4, 2.0))
    with pytest.raises(ValueError):
        Lattice.from_frame(spark.createDataFrame([(1, 2.0), (1, 3.0)], "k long, v double"), ["k"], ["v"])
    dense = Lattice.from_frame(spark.createDataFrame([(1, "a", 2.0), (2, "b", float("nan"))], "k long, c string, v double"), ["k", "c"], ["v"], densify=True)
    same(dense, [[2.0, np.nan], [np.nan, np.nan]])
    long = from_numpy(spark, np.arange(50.0), ["t"], layout=Layout(block=8, groups=4))
    table = long.to_table().select((F.col("t") * 3).alias("t"), "v")
    again = Lattice.from_frame(table, ["t"], ["v"], layout=Layout(block=8, groups=4))
    same(again, np.arange(50.0))
    same(again.cumsum("t"), np.arange(50.0).cumsum())


def test_empty_and_single(spark):
    none = from_numpy(spark, np.empty((0, 2)), ["t", "y"])
    assert none.sum("t").to_table().count() == 0
    one = from_numpy(spark, np.array([[2.0]]), ["t", "y"])
    same(one.cumsum("t"), [[2.0]])
    same(one.rolling("t", 3, min_periods=1).mean(), [[2.0]])
    same(one.diff("t"), np.empty((0, 1)))
