"""Decomposition, halos and folds."""

import numpy as np
import pytest

from cellweave.plans import blocks, halos
from cellweave.sources import from_numpy


def test_extents():
    for n in range(0, 20):
        for size in range(1, 7):
            for least in (None, 2, 5):
                parts = blocks.compute_domains(n, size, least)
                assert parts[0][0] == 0 and parts[-1][1] == n
                assert all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
                lengths = [b - a for a, b in parts if b > a]
                assert not lengths or max(lengths) - min(lengths) <= 1
                assert not least or n < least or min(lengths) >= least


def test_layouts():
    assert blocks.define_layout([100, 100], 4) == (2, 2)
    assert blocks.define_layout([1000, 10], 4) == (4, 1)
    assert blocks.define_layout([2, 100], 8) == (1, 8) and blocks.define_layout([7], 3) == (3,)
    assert sorted(blocks.shapes(4, 2)) == [(1, 4), (2, 2), (4, 1)]
    for extents, n in (((30, 20, 10), 12), ((5, 5, 5), 8), ((1, 1, 9), 6)):
        got = blocks.define_layout(extents, n)
        full = lambda s, e=extents: np.prod([min(a, b) for a, b in zip(s, e, strict=True)])
        assert np.prod(got) == n and full(got) == max(map(full, blocks.shapes(n, 3)))
    assert blocks.define_layout((5, 5, 5), 8) == (2, 2, 2)
    with pytest.raises(ValueError):
        blocks.define_layout([], 2)


def test_chunk_bounds():
    assert blocks.aligned_domains(100, 3, [4, 6]) == [(0, 36), (36, 72), (72, 100)]
    assert blocks.aligned_domains(10, 4, [4]) == blocks.compute_domains(10, 4)
    chunks = blocks.save_chunks((100, 8), [blocks.aligned_domains(100, 3, [4, 6]), [(0, 8)]], 8, 1000)
    assert 36 % chunks[0] == 0 and 8 % chunks[1] == 0 and chunks[0] * chunks[1] * 8 <= 1000


def test_domain():
    d = blocks.Domain(("y", "x"), (11, 13), (2, 3), {"x": (1, 2)}, frozenset({"x"}))
    assert d.compute_domain("x", 0) == (0, 5) and d.data_domain("x", 0) == (-1, 7)
    assert d.neighbours("x", 0) == (2, 1) and d.neighbours("y", 0) == (None, 3)
    assert sum(d.extents("y")) == 11
    with pytest.raises(blocks.DomainMismatchError):
        d.axis("z")


@pytest.mark.parametrize("cyclic", [False, True])
def test_halo(spark, cyclic):
    n, parts, before, after = 11, 4, 3, 2
    x = from_numpy(spark, np.arange(n, dtype=float), ["t"])
    rows = x.halo("t", before, after, blocks=parts, cyclic=cyclic).collect()
    got = {}
    for r in rows:
        got.setdefault(r["block"], []).append((r["at"], r["v"], r["halo"]))
    for b, (lo, hi) in enumerate(blocks.compute_domains(n, parts)):
        span = range(lo - before, hi + after)
        want = [(p, float(p % n), not lo <= p < hi) for p in span if cyclic or 0 <= p < n]
        assert sorted(got[b]) == want


def test_fold_and_boundary(spark):
    v = np.arange(12.0).reshape(4, 3)
    x = from_numpy(spark, v, ["y", "x"])
    rows = halos.fold(x.frame(), ["v"], "y", "x", x.sizes, 2, "north", -1).collect()
    cells = {(r["__pos_y"], r["__pos_x"]): r["v"] for r in rows}
    assert cells[(4, 0)] == -v[3, 2] and cells[(5, 1)] == -v[2, 1] and len(cells) == 18
    south = {(r["__pos_y"], r["__pos_x"]): r["v"] for r in halos.fold(x.frame(), ["v"], "y", "x", x.sizes, 1, "south").collect()}
    assert south[(-1, 0)] == v[0, 2]
    edge = halos.boundary(x.frame(), "y", 4, 2).select("__pos_y").distinct().count()
    assert edge == 4
    assert halos.global_field(x.frame(), "y", 4).count() == 12
    with pytest.raises(ValueError):
        halos.global_field(x.frame().where("__pos_y <> 1"), "y", 4)
