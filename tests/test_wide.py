"""Long axes in ranges, halos in several dimensions, raw operands, own reductions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import Layout
from cellweave.operators import reductions
from cellweave.plans import halos
from cellweave.sources import from_numpy

RNG = np.random.default_rng(5)


def same(x, want):
    np.testing.assert_allclose(x.to_numpy().astype(float), np.asarray(want, float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("block", [64, 100_000])
def test_neighbours_in_ranges(spark, block):
    """interp, reindex, sel and sortby agree with NumPy however the axis is cut."""
    n = 700
    at = np.sort(RNG.choice(5000, n, replace=False)).astype(float)
    v = RNG.normal(size=n)
    x = from_numpy(spark, v, ["t"], coords={"t": at.tolist()}, layout=Layout(block=block, groups=2))
    asked = np.sort(np.r_[RNG.uniform(-50, 5100, 400), at[::9]])
    inside = (asked >= at[0]) & (asked <= at[-1])
    same(x.interp("t", asked.tolist()), np.where(inside, np.interp(asked, at, v), np.nan))
    lo, hi = np.searchsorted(at, asked, "right") - 1, np.searchsorted(at, asked, "left")
    pick = lambda i: np.where((i >= 0) & (i < n), v[np.clip(i, 0, n - 1)], np.nan)
    same(x.reindex(t=asked.tolist(), method="ffill"), pick(lo))
    same(x.reindex(t=asked.tolist(), method="bfill"), pick(hi))
    below, above = np.where(lo >= 0, asked - at[np.clip(lo, 0, n - 1)], np.inf), np.where(hi < n, at[np.clip(hi, 0, n - 1)] - asked, np.inf)
    same(x.reindex(t=asked.tolist(), method="nearest"), v[np.where(above <= below, np.clip(hi, 0, n - 1), np.clip(lo, 0, n - 1))])
    same(x.reindex(t=asked.tolist(), method="nearest", tolerance=1.0), np.where(np.minimum(above, below) <= 1.0, v[np.where(above <= below, np.clip(hi, 0, n - 1), np.clip(lo, 0, n - 1))], np.nan))
    ties = from_numpy(spark, np.round(v, 1), ["t"], coords={"t": at.tolist()}, layout=Layout(block=block, groups=2))
    same(ties.sortby(ties), np.sort(np.round(v, 1)))
    order = np.argsort(np.round(v, 1), kind="stable")
    assert [r[1] for r in ties.sortby(ties, ascending=False).coordinate("t").orderBy("__pos_t").collect()] == at[order[::-1]].tolist()
    same(ties.largest("t", ties, 7), np.sort(np.round(v, 1))[::-1][:7])
    same(x.where(x > 0.5, drop=True), v[v > 0.5])
    assert x.sel(t=slice(at[5], at[60])).sizes == {"t": 56}


def test_half_a_million_rows(spark):
    """No step is quadratic: in ranges of the default length these end within seconds."""
    n = 500_000
    x = from_numpy(spark, np.arange(n) % 1013.0, ["t"], layout=Layout(block=65_536, groups=4))
    holes = x.where(x > 900.0)
    assert holes.bfill("t").count("t").to_numpy() == max(i for i in range(n - 2000, n) if i % 1013 > 900) + 1
    assert x.reindex(t=spark.range(0, n, 5).select(F.col("id").alias("t")), method="nearest").count("t").to_numpy() == n / 5
    assert x.sortby(x).isel(t=n - 1).to_numpy() == 1012


def test_halos_with_corners(spark):
    v = np.arange(35.0).reshape(5, 7)
    x = from_numpy(spark, v, ["y", "x"])
    rows = x.halo(["y", "x"], 1, 1, blocks=[2, 3], cyclic=[False, True]).collect()
    got = {}
    for r in rows:
        got.setdefault((r["block"]["y"], r["block"]["x"]), {})[r["at"]["y"], r["at"]["x"]] = (r["v"], r["halo"])
    for by, (y0, y1) in enumerate([(0, 3), (3, 5)]):
        for bx, (x0, x1) in enumerate([(0, 3), (3, 5), (5, 7)]):
            want = {(i, j): (v[i, j % 7], not (y0 <= i < y1 and x0 <= j < x1)) for i in range(y0 - 1, y1 + 1) if 0 <= i < 5 for j in range(x0 - 1, x1 + 1)}
            assert got[by, bx] == want
    with pytest.raises(ValueError):
        halos.with_halos(x.frame(), [])


def test_groups_of_fields(spark):
    a, b = from_numpy(spark, np.arange(6.0), ["t"], name="a"), from_numpy(spark, np.arange(6.0) * 2, ["t"], name="b")
    rows = halos.update_group([a.frame(), b.frame()], ["__pos_t", "t"], "t", 6, 2, 1, 1).collect()
    assert sorted((r["block"], r["at"], r["a"], r["b"]) for r in rows) == sorted((k, i, float(i), 2.0 * i) for k in (0, 1) for i in (range(4) if k == 0 else range(2, 6)))
    with pytest.raises(ValueError):
        halos.update_group([], ["t"], "t", 6, 2, 1, 1)
    c = from_numpy(spark, np.arange(6.0)[::-1].copy(), ["t"], name="a")
    top = halos.fold_fields([a.frame(), c.frame()], ["t"], ["a"], "max").orderBy("t").collect()
    assert [r["a"] for r in top] == [5, 4, 3, 3, 4, 5]
    offsets = halos.partition_offsets(spark.range(10).repartition(3)).orderBy("partition").collect()
    assert sum(r["n"] for r in offsets) == 10 and [r["offset"] for r in offsets] == np.r_[0, np.cumsum([r["n"] for r in offsets])[:-1]].tolist()


def test_raw_operands_and_apply(spark):
    v = RNG.normal(size=(4, 3))
    x, w, z = from_numpy(spark, v, ["t", "y"]), from_numpy(spark, v[0], ["y"], name="w"), from_numpy(spark, v * 3, ["t", "y"], name="z")
    same(x + v[1], v + v[1])
    same(v[:, :1] - x, v[:, :1] - v)
    same(np.maximum(x, np.ones((4, 3))), np.maximum(v, 1))
    same(x * np.float64(2.0), v * 2)
    with pytest.raises(ValueError):
        x + np.ones(5)
    same(x.apply(lambda a, b, k, c: a + b * k - c, w, 2.0, z), v + v[0] * 2 - v * 3)


def test_own_reductions(spark):
    reductions.register("spread", lambda c, of: of(F.max(c)) - of(F.min(c)))
    v = np.arange(12.0) ** 2
    x = from_numpy(spark, v, ["t"])
    same(x.rolling("t", 3).reduce("spread"), [np.nan, *(v[2:] - v[:-2]), np.nan])
    same(x.coarsen_reduce("t", 4, "spread"), v[3::4] - v[::4])
    same(x.rolling("t", 2, center=False).reduce("prod"), [np.nan, *(v[1:] * v[:-1])])
    with pytest.raises(ValueError):
        x.rolling("t", 3).reduce("unheard of")


def test_products_keep_signs(spark):
    prod = lambda a: from_numpy(spark, np.array(a), ["i"]).exact_prod().to_numpy().item()
    assert np.signbit(prod([-0.0, 3.0])) and not np.signbit(prod([-0.0, -3.0])) and prod([0.0, -2.0]) == 0
    assert prod([np.inf, -2.0]) == -np.inf and np.isnan(prod([np.inf, 0.0])) and prod([]) == 1
    assert np.isclose(prod([1e300, 1e300, 1e-300, 1e-299]), 10.0, rtol=1e-12) and prod([5e-324, 2.0]) == 1e-323
    assert prod([2.0**1023, 2.0]) == np.inf and prod([2.0**-600, 2.0**-600]) == 0
