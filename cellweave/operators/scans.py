"""Rolling and block reductions, prefix scans, stencils, fills and interpolation along one dimension."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.elementwise import as_column, divide, ieee_divide, no_nan
from ..plans.positions import neighbours
from ..plans.windows import Layout, along, pos, scan, stencil
from ..schema import Group
from .reductions import OWN, aggregate, skips

ROLLING = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "prod": F.product, "first": lambda c: F.first(c, True), "last": lambda c: F.last(c, True)}
Sizes = dict[str, int]


def _middle(c: Column, of: Callable[[Column], Column]) -> Column:
    """The median of a frame, whose length the window bounds: Spark's own takes no frame."""
    values = F.array_sort(of(F.collect_list(c)))
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


OWN.setdefault("median", _middle)


def _renamed(group: Group, df: DataFrame, made: list[str], kinds: dict[str, str]) -> Group:
    """Columns __new_<n> of df take the names n."""
    out = df.select(*group.keys(), *(F.col(f"__new_{n}").alias(n) for n in made))
    return Group(group.dims, out, {n: F.col(n) for n in made}, kinds)


def rolling(group: Group, dim: str, window: int, op: str, center: bool, min_periods: int | None, sizes: Sizes, layout: Layout) -> Group:
    """A reduction over the window around (or before) each cell, missing where fewer than min_periods (default: window) values are valid.

    An even centred window has its extra cell before the own one.
    """
    if window < 1:
        raise ValueError("a window has at least one cell")
    if op != "count" and op not in ROLLING and op not in OWN:
        raise ValueError(f"rolling reductions are {(*ROLLING, 'count', *OWN)}, not {op!r}")
    need = window if min_periods is None else min_periods
    before = window // 2 if center else window - 1
    after = window - 1 - before
    names = list(group.exprs)

    def make(w: WindowSpec) -> dict[str, Column]:
        frame, out = w.rowsBetween(-before, after), {}
        for n in names:
            c = F.col(n).cast("double") if group.kinds[n] != "float" else F.col(n)
            valid = F.count(c).over(frame)
            if op == "count":
                out[f"__new_{n}"] = valid.cast("double")
                continue
            over = lambda a, frame=frame: a.over(frame)
            value = OWN[op](c, over) if op in OWN else over(ROLLING[op](c))
            out[f"__new_{n}"] = F.when(valid >= need, F.coalesce(value, F.lit(0.0)) if op == "sum" else value)
        return out

    df = stencil(group.frame(), group.dims, dim, sizes, before, after, make, layout)
    return _renamed(group, df, names, dict.fromkeys(names, "float"))


def coarsen(group: Group, dim: str, window: int, op: str, boundary: str, side: str, coord_func: str, n: int) -> tuple[Group, int]:
    """Reduce non-overlapping blocks of `window` cells. boundary: exact, trim or pad; side: where odd cells are cut or padded."""
    if window < 1:
        raise ValueError("a window has at least one cell")
    if boundary not in ("exact", "trim", "pad") or side not in ("left", "right"):
        raise ValueError("boundary is exact, trim or pad, and side left or right")
    rest = n % window
    if boundary == "exact" and rest:
        raise ValueError(f"{n} cells along {dim!r} are not a multiple of {window}")
    shift = 0 if side == "left" or not rest else (-rest if boundary == "trim" else window - rest)
    frame = group.frame().withColumn("__at", F.col(pos(dim)) + shift)
    if boundary == "trim":
        frame = frame.where((F.col("__at") >= 0) & (F.col("__at") < n // window * window))
    keys = group.keys(dim)
    made = {v: aggregate(op, F.col(v), group.kinds[v], at=F.col(pos(dim))) for v in group.exprs}
    label = {"mean": F.avg, "min": F.min, "max": F.max, "first": lambda c: F.min_by(c, F.col(pos(dim))), "last": lambda c: F.max_by(c, F.col(pos(dim)))}[coord_func]
    times = dict(frame.dtypes)[dim].startswith(("timestamp", "date"))
    c = F.col(dim)
    if coord_func == "mean" and times:
        low = F.lit("1970-01-01").cast("timestamp_ntz")
        coord = F.timestamp_add("MICROSECOND", F.floor(F.avg(F.timestamp_diff("MICROSECOND", low, c.cast("timestamp_ntz")))).cast("long"), low)
    else:
        coord = label(c)
    df = frame.groupBy(F.floor(F.col("__at") / window).alias("__block"), *keys).agg(coord.alias(dim), *(x.alias(v) for v, (x, _) in made.items())).withColumnRenamed("__block", pos(dim))
    size = n // window if boundary != "pad" else -(-n // window)
    return Group(group.dims, df, {v: F.col(v) for v in made}, {v: k for v, (_, k) in made.items()}), size


def cumulative(group: Group, dim: str, op: str, skipna: bool | None, sizes: Sizes, layout: Layout) -> Group:
    """cumsum and cumprod: a skipped missing value counts as 0 or 1, another one makes all that follow missing."""
    names, total, combine = list(group.exprs), {}, {}
    plus = op == "cumsum"
    for n in names:
        c = F.col(n).cast("long") if group.kinds[n] == "bool" else F.col(n)
        c = c if plus else c.cast("double")
        total |= {f"__t_{n}": F.sum(c) if plus else F.product(c), f"__m_{n}": F.count(F.lit(1)) - F.count(c)}

    def prefix(w: WindowSpec) -> dict[str, Column]:
        fold = F.sum if plus else F.product
        return {f"__p_{n}": fold(f"__t_{n}").over(w) for n in names} | {f"__q_{n}": F.sum(f"__m_{n}").over(w) for n in names}

    def local(w: WindowSpec) -> dict[str, Column]:
        w, out = w.rowsBetween(Window.unboundedPreceding, 0), {}
        for n in names:
            c = F.col(n).cast("long") if group.kinds[n] == "bool" else F.col(n)
            out[f"__new_{n}"] = F.coalesce(F.sum(c).over(w), F.lit(0)) if plus else F.coalesce(F.product(c.cast("double")).over(w), F.lit(1.0))
            out[f"__gap_{n}"] = F.count(F.lit(1)).over(w) - F.count(c).over(w)
        return out

    kinds = {}
    for n in names:
        own, past = F.col(f"__new_{n}"), F.coalesce(F.col(f"__p_{n}"), F.lit(0 if plus else 1.0))
        value = own + past if plus else own * past
        kinds[n] = "float" if group.kinds[n] == "float" else "int"
        value = value.cast("double" if kinds[n] == "float" else "long")
        if not skips(group.kinds[n], skipna):
            value = F.when(F.col(f"__gap_{n}") + F.coalesce(F.col(f"__q_{n}"), F.lit(0)) == 0, value)
        combine[f"__new_{n}"] = value
    df = scan(group.frame(), group.dims, dim, sizes, layout, total=total, prefix=prefix, local=local, combine=combine)
    return _renamed(group, df, names, kinds)


def fill(group: Group, dim: str, limit: int | None, forward: bool, sizes: Sizes, layout: Layout) -> Group:
    """The last valid value before (forward) or the next one after each missing cell, at most `limit` cells away."""
    names = list(group.exprs)
    if limit is not None:
        if limit < 1:
            raise ValueError("limit is at least 1")

        def make(w: WindowSpec) -> dict[str, Column]:
            return {f"__new_{n}": F.last(n, True).over(w.rowsBetween(-limit, 0)) if forward else F.first(n, True).over(w.rowsBetween(0, limit)) for n in names}

        df = stencil(group.frame(), group.dims, dim, sizes, limit if forward else 0, 0 if forward else limit, make, layout)
        return _renamed(group, df, names, group.kinds)
    at = F.col(pos(dim))
    pick = F.max_by if forward else F.min_by
    total = {f"__t_{n}": pick(F.col(n), F.when(F.col(n).isNotNull(), at)) for n in names}

    def prefix(w: WindowSpec) -> dict[str, Column]:
        return {f"__p_{n}": F.last(f"__t_{n}", True).over(w) for n in names}

    def local(w: WindowSpec) -> dict[str, Column]:
        return {f"__new_{n}": F.last(n, True).over((w if forward else w.orderBy(F.desc(pos(dim)))).rowsBetween(Window.unboundedPreceding, 0)) for n in names}

    combine = {f"__new_{n}": F.coalesce(F.col(f"__new_{n}"), F.col(f"__p_{n}").cast(group.frame().schema[n].dataType)) for n in names}
    df = scan(group.frame(), group.dims, dim, sizes, layout, total=total, prefix=prefix, local=local, combine=combine, backwards=not forward)
    return _renamed(group, df, names, group.kinds)


def diff(group: Group, dim: str, n: int, label: str, sizes: Sizes, layout: Layout) -> Group:
    """n-th difference; the labels kept are the upper or lower ones."""
    names, kinds = list(group.exprs), {v: "int" if k == "bool" else k for v, k in group.kinds.items()}

    def make(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for v in names:
            c = F.col(v).cast("long") if group.kinds[v] == "bool" else F.col(v)
            value = None
            # repeated differences, in the order a chain of them takes
            terms = [F.lag(c, i).over(w) if i else c for i in range(n + 1)] if label == "upper" else [F.lead(c, n - i).over(w) if n - i else c for i in range(n + 1)]
            while len(terms) > 1:
                terms = [a - b for a, b in zip(terms[:-1], terms[1:], strict=True)]
            value = terms[0]
            out[f"__new_{v}"] = value
        return out

    df = stencil(group.frame(), group.dims, dim, sizes, n, n, make, layout)
    p = F.col(pos(dim))
    df = df.where(p >= n).withColumn(pos(dim), p - n) if label == "upper" else df.where(p < sizes[dim] - n)
    return _renamed(group, df, names, kinds)


def shift(group: Group, dim: str, periods: int, fill_value: object, sizes: Sizes, layout: Layout) -> Group:
    """Move values, not labels; cells from beyond the edge get fill_value (missing by default)."""
    names, far = list(group.exprs), min(abs(periods), sizes[dim])

    def make(w: WindowSpec) -> dict[str, Column]:
        return {f"__new_{v}": (F.lag(v, far) if periods >= 0 else F.lead(v, far)).over(w) if far else F.col(v) for v in names}

    df = stencil(group.frame(), group.dims, dim, sizes, far, far, make, layout)
    kinds = dict(group.kinds)
    if fill_value is not None and periods:
        edge = F.col(pos(dim)) < periods if periods > 0 else F.col(pos(dim)) >= sizes[dim] + periods
        df = df.withColumns({f"__new_{v}": F.when(edge, as_column(fill_value)).otherwise(F.col(f"__new_{v}")) for v in names})
    elif periods:
        kinds = {v: "float" if k == "int" else k for v, k in kinds.items()}
        df = df.withColumns({f"__new_{v}": F.col(f"__new_{v}").cast("double") for v in names if group.kinds[v] == "int"})
    return _renamed(group, df, names, kinds)


def roll(group: Group, dim: str, by: int, sizes: Sizes) -> Group:
    """Circular shift: values move, labels stay. Positions are re-keyed and joined to their labels."""
    n = sizes[dim]
    if not n or by % n == 0:
        return group
    frame = group.frame()
    labels = frame.select(pos(dim), dim).distinct()
    moved = frame.drop(dim).withColumn(pos(dim), F.pmod(F.col(pos(dim)) + by, F.lit(n)))
    return Group(group.dims, moved.join(labels, pos(dim)).select(*frame.columns), {v: F.col(v) for v in group.exprs}, group.kinds)


def pad(group: Group, dim: str, before: int, after: int, value: object, sizes: Sizes) -> Group:
    """Constant cells at both ends; their labels are missing."""
    if before < 0 or after < 0:
        raise ValueError("widths must not be negative")
    frame = group.frame()
    kept = frame.withColumn(pos(dim), F.col(pos(dim)) + before)
    if not before + after:
        return group
    others = [c for c in group.keys(dim)]
    spot = F.col("id")
    edge = frame.sparkSession.range(before + after).select(F.when(spot < before, spot).otherwise(spot + sizes[dim]).alias(pos(dim)))
    grid = frame.select(*others).distinct().crossJoin(edge) if others else edge
    types = dict(frame.dtypes)
    # an int can't hold a missing value's float; it is widened as arrays are
    kinds = {v: "float" if k == "int" and (value is None or isinstance(value, float)) else k for v, k in group.kinds.items()}
    new = {v: "double" if kinds[v] == "float" and group.kinds[v] == "int" else types[v] for v in group.exprs}
    cells = grid.select(*others, pos(dim), F.lit(None).cast(types[dim]).alias(dim), *(as_column(value).cast(new[v]).alias(v) for v in group.exprs))
    kept = kept.withColumns({v: F.col(v).cast(new[v]) for v in group.exprs})
    return Group(group.dims, kept.select(*frame.columns).unionByName(cells), {v: F.col(v) for v in group.exprs}, kinds)


def _as_number(df: DataFrame, dim: str, unit_us: int = 1) -> Column:
    c = F.col(dim)
    if dict(df.dtypes)[dim].startswith(("timestamp", "date")):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / unit_us
    return c.cast("double")


UNITS = {"us": 1, "ms": 10**3, "s": 10**6, "m": 60 * 10**6, "min": 60 * 10**6, "h": 3600 * 10**6, "D": 86_400 * 10**6, "W": 7 * 86_400 * 10**6}


def differentiate(group: Group, dim: str, edge_order: int, datetime_unit: str | None, nan: bool, sizes: Sizes, layout: Layout) -> Group:
    """Second-order differences on unequal steps; one-sided of order 1 or 2 at the ends.

    Steps of zero (repeated labels) give signed infinities, and 0 / 0 a NaN (nan) or a missing value.
    """
    if edge_order not in (1, 2):
        raise ValueError("edge_order is 1 or 2")
    if sizes[dim] < edge_order + 1:
        raise ValueError(f"differentiate needs at least {edge_order + 1} cells along {dim!r}")
    names, frame = list(group.exprs), group.frame()
    frame = frame.withColumn("__x", _as_number(frame, dim, UNITS[datetime_unit or "us"]))

    def make(w: WindowSpec) -> dict[str, Column]:
        return {f"__{side}{k}_{c}": fn(c, k).over(w) for side, fn in (("lag", F.lag), ("lead", F.lead)) for k in range(1, edge_order + 1) for c in ("__x", *names)}

    df = stencil(frame, group.dims, dim, sizes, 2, 2, make, layout)
    at = lambda c, k: F.col(f"__lag{-k}_{c}" if k < 0 else f"__lead{k}_{c}" if k else c)
    x, p, made = F.col("__x"), F.col(pos(dim)), {}
    hs, hd = x - at("__x", -1), at("__x", 1) - x
    for v in names:
        f, back, ahead = F.col(v).cast("double"), at(v, -1), at(v, 1)
        inner = ieee_divide(hs * hs * ahead + (hd * hd - hs * hs) * f - hd * hd * back, hs * hd * (hd + hs))
        if edge_order == 1:
            lo, hi = ieee_divide(ahead - f, hd), ieee_divide(f - back, hs)
        else:
            h1, h2 = hd, at("__x", 2) - at("__x", 1)
            lo = ieee_divide(-(2 * h1 + h2), h1 * (h1 + h2)) * f + ieee_divide(h1 + h2, h1 * h2) * ahead - ieee_divide(h1, h2 * (h1 + h2)) * at(v, 2)
            g1, g2 = at("__x", -1) - at("__x", -2), hs
            hi = ieee_divide(g2, g1 * (g1 + g2)) * at(v, -2) - ieee_divide(g2 + g1, g1 * g2) * back + ieee_divide(2 * g2 + g1, g2 * (g1 + g2)) * f
        value = F.when(p == 0, lo).when(p == sizes[dim] - 1, hi).otherwise(inner)
        made[f"__new_{v}"] = value if nan else no_nan(value)
    return _renamed(group, df.withColumns(made), names, dict.fromkeys(names, "float"))


def _spline(x: np.ndarray, y: np.ndarray, t: np.ndarray, degree: int) -> np.ndarray:
    """Interpolating spline of degree 2 or 3 (not-a-knot ends), by solving for B-spline coefficients."""
    n, k = len(x), degree
    if n <= k:
        raise ValueError(f"a spline of degree {k} needs more than {k} cells")
    inner = (x[:-1] + x[1:])[1:-1] / 2 if k == 2 else x[2:-2]
    knots = np.r_[[x[0]] * (k + 1), inner, [x[-1]] * (k + 1)]

    def basis(at: np.ndarray) -> np.ndarray:
        b = ((at[:, None] >= knots[:-1]) & (at[:, None] < knots[1:])).astype(float)
        b[at >= x[-1], n - 1] = 1.0
        for d in range(1, k + 1):
            m = len(knots) - 1 - d
            with np.errstate(divide="ignore", invalid="ignore"):
                left = np.nan_to_num((at[:, None] - knots[:m]) / (knots[d : d + m] - knots[:m]), posinf=0, neginf=0)
                right = np.nan_to_num((knots[d + 1 : d + 1 + m] - at[:, None]) / (knots[d + 1 : d + 1 + m] - knots[1 : m + 1]), posinf=0, neginf=0)
            b = left * b[:, :m] + right * b[:, 1 : m + 1]
        return b

    out = np.full(len(t), np.nan)
    inside = (t >= x[0]) & (t <= x[-1])
    out[inside] = basis(t[inside]) @ np.linalg.solve(basis(x), y)
    return out


#: Cells of a spline's block, and of what a block sees beyond its ends: a cell's pull on a spline falls by two thirds or more with each cell in between.
SPLINE_BLOCK, SPLINE_REACH = 256, 48


def _splines(group: Group, dim: str, targets: DataFrame, n_targets: int, degree: int, sizes: Sizes, layout: Layout) -> Group:
    """Splines through overlapping blocks of cells; each block gives the values at the targets that lie in it. A missing cell makes its block's values missing."""
    import pandas as pd

    frame, names, others, at = group.frame(), list(group.exprs), group.keys(dim), F.col(pos(dim))
    last = max(0, (sizes[dim] - 1) // SPLINE_BLOCK)
    if last and (sizes[dim] - last * SPLINE_BLOCK) <= SPLINE_REACH:
        last -= 1
    block = lambda p: F.least(F.greatest(F.floor(p / SPLINE_BLOCK), F.lit(0)), F.lit(last))
    source = frame.withColumn("__b", F.explode(F.sequence(block(at - SPLINE_REACH), block(at + SPLINE_REACH)))).drop(*(d for d in group.dims if d != dim))
    known = frame.select(F.col(dim).alias("label"), at.alias("old")).distinct()
    near = neighbours(known, targets.select(F.col(dim).cast(dict(frame.dtypes)[dim] if not dict(frame.dtypes)[dim].endswith("int") else "double").alias("label"), at.alias("new")), sizes[dim] + n_targets, layout.block)
    asked = near.select(F.col("new").alias("__t"), F.col("label").alias("__x"), F.coalesce(block(F.col("lo.old")), F.lit(0)).alias("__b"))
    asked = asked.crossJoin(F.broadcast(frame.select(*others).distinct())) if others else asked
    series = [pos(d) for d in group.dims if d != dim]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in frame.select(*others).dtypes), f"`{pos(dim)}` long", f"`{dim}` double", *(f"`{n}` double" for n in names)])

    def solve(cells: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        cells, t = cells.sort_values(pos(dim)), wanted["__x"].to_numpy(float)
        out = pd.DataFrame({c: wanted[c] for c in others} | {pos(dim): wanted["__t"], dim: t})
        for n in names:
            y, x = cells[n].to_numpy(float), cells[dim].to_numpy(float)
            out[n] = _spline(x, y, t, degree) if not np.isnan(y).any() else np.nan
        return out

    df = source.groupBy(*series, "__b").cogroup(asked.groupBy(*series, "__b")).applyInPandas(solve, schema)
    df = df.withColumns({n: no_nan(F.col(n)) for n in names})
    return Group(group.dims, df.select(*group.keys(), *names), {n: F.col(n) for n in names}, dict.fromkeys(names, "float"))


def interp(group: Group, dim: str, targets: DataFrame, n_targets: int, method: str, sizes: Sizes, layout: Layout) -> Group:
    """Values at new labels (targets: position, label); missing outside the source's range.

    linear and nearest bracket each target between its neighbours on the
    coordinate alone and then join the two rows; quadratic and cubic solve
    splines over blocks of cells.
    """
    frame, names = group.frame(), list(group.exprs)
    others = group.keys(dim)
    if method in ("quadratic", "cubic"):
        return _splines(group, dim, targets, n_targets, 2 if method == "quadratic" else 3, sizes, layout)
    if method not in ("linear", "slinear", "nearest"):
        raise ValueError(f"unknown method {method!r}")
    source = frame.select(F.col(dim).alias("label"), F.col(pos(dim)).alias("old")).distinct()
    asked = targets.select(F.col(dim).alias("label"), F.col(pos(dim)).alias("new"))
    # bracketed on the coordinate alone; at a known label both neighbours are that label
    bracket = neighbours(source, asked, sizes[dim] + n_targets, layout.block)
    bracket = bracket.select(F.col("new").alias("t"), F.col("label").alias("tx"), F.col("lo.old").alias("lp"), F.col("hi.old").alias("hp"), F.col("lo.label").alias("lx"), F.col("hi.label").alias("hx"))
    lows = frame.select(F.col(pos(dim)).alias("lp"), *others, *(F.col(n).alias(f"__l_{n}") for n in names))
    highs = frame.select(F.col(pos(dim)).alias("hp"), *(pos(d) for d in group.dims if d != dim), *(F.col(n).alias(f"__h_{n}") for n in names))
    grid = bracket.crossJoin(frame.select(*others).distinct()) if others else bracket
    keys = [pos(d) for d in group.dims if d != dim]
    drop_labels = [d for d in group.dims if d != dim]
    joined = grid.join(lows.drop(*drop_labels), ["lp", *keys], "left").join(highs, ["hp", *keys], "left")
    num = lambda c: (F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")) if dict(frame.dtypes)[dim].startswith("timestamp") else F.col(c).cast("double"))
    share = F.when(F.col("hp") == F.col("lp"), F.lit(0.0)).otherwise(divide(num("tx") - num("lx"), num("hx") - num("lx")))
    inside = F.col("lp").isNotNull() & F.col("hp").isNotNull()
    value = {}
    for n in names:
        a, b = F.col(f"__l_{n}").cast("double"), F.col(f"__h_{n}").cast("double")
        value[n] = F.when(inside, F.when(share <= 0.5, a).otherwise(b) if method == "nearest" else F.when(share == 0, a).otherwise(a + (b - a) * share))
    df = joined.select(*others, F.col("t").alias(pos(dim)), F.col("tx").alias(dim), *(c.alias(n) for n, c in value.items()))
    return Group(group.dims, df.select(*group.keys(), *names), {n: F.col(n) for n in names}, dict.fromkeys(names, "float"))
