"""Global and grouped reductions as Spark aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.elementwise import Kind, _truth
from ..plans.windows import pos
from ..schema import Group

QUANTILE_METHODS = ("linear", "lower", "higher", "nearest", "midpoint")


#: Reductions by names of one's own.
OWN: dict[str, Callable[[Column, Callable[[Column], Column]], Column]] = {}


def register(name: str, fn: Callable[[Column, Callable[[Column], Column]], Column]) -> None:
    """Make a reduction known to rolling and coarsened windows.

    fn(values, of) returns a column made of aggregates of values, each passed
    through `of`, which ties it to the window or group: for the range of values
    `lambda c, of: of(F.max(c)) - of(F.min(c))`.
    """
    OWN[name] = fn


def skips(kind: Kind, skipna: bool | None) -> bool:
    """By default only floats skip missing values."""
    return kind == "float" if skipna is None else skipna


def whole(c: Column, value: Column, skip: bool) -> Column:
    """value, or missing if a missing value isn't skipped."""
    return value if skip else F.when(F.count(c) == F.count(F.lit(1)), value)


def aggregate(op: str, c: Column, kind: Kind, *, skipna: bool | None = None, min_count: int | None = None, ddof: int = 0, at: Column | None = None, q=None) -> tuple[Column, Kind]:
    """The aggregate column of a named reduction, and its kind. `at` orders first and last."""
    skip = skips(kind, skipna)
    num = c.cast("long") if kind == "bool" else c
    if op in ("sum", "prod"):
        if op == "sum":
            value, out = F.coalesce(F.sum(num), F.lit(0.0 if kind == "float" else 0)), "float" if kind == "float" else "int"
        else:
            product = F.coalesce(F.product(num.cast("double")), F.lit(1.0))
            value, out = (product, "float") if kind == "float" else (F.rint(product).cast("long"), "int")
        if min_count is not None and skip:
            value = F.when(F.count(c) >= min_count, value)
        return whole(c, value, skip), out
    if op == "count":
        return F.count(c), "int"
    if op == "mean":
        return whole(c, F.avg(num), skip), "float"
    if op in ("min", "max"):
        if kind == "bool":
            return whole(c, F.bool_and(c) if op == "min" else F.bool_or(c), skip), "bool"
        return whole(c, F.min(c) if op == "min" else F.max(c), skip), kind
    if op == "any":
        return F.coalesce(F.bool_or(_truth(c)), F.lit(False)), "bool"
    if op == "all":
        return F.coalesce(F.bool_and(_truth(c)), F.lit(True)), "bool"
    if op in ("var", "std"):
        n, x = F.count(c), num.cast("double")
        value = F.when(n > ddof, F.var_pop(x) * n / F.when(n > ddof, n - ddof)) if ddof else F.var_pop(x)
        return whole(c, F.sqrt(value) if op == "std" else value, skip), "float"
    if op in ("first", "last"):
        pick = F.min_by if op == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), at) if skip and kind == "float" else at), kind
    if op == "median":
        return whole(c, F.median(num), skip), "float"
    if op == "quantile":
        return whole(c, quantile(num, *q), skip), "float"
    if op in OWN:
        return whole(c, OWN[op](num, lambda a: a), skip), "float"
    raise ValueError(f"unknown reduction {op!r}")


def quantile(c: Column, qs: list[float] | float, method: str) -> Column:
    """One quantile, or an array of several. The linear method is exact and combines partially; others sort each group."""
    if any(not 0 <= q <= 1 for q in (qs if isinstance(qs, list) else [qs])):
        raise ValueError("quantiles lie in [0, 1]")
    if method == "linear":
        return F.percentile(c.cast("double"), F.array(*map(F.lit, qs)) if isinstance(qs, list) else F.lit(qs))
    if method not in QUANTILE_METHODS:
        raise ValueError(f"method must be one of {QUANTILE_METHODS}")
    values = F.array_sort(F.collect_list(c.cast("double")))

    def one(q: float) -> Column:
        h = (F.size(values) - 1) * F.lit(q)
        lo, hi = F.get(values, F.floor(h).cast("int")), F.get(values, F.ceil(h).cast("int"))
        return {"lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": F.get(values, F.bround(h).cast("int"))}[method]

    return F.array(*map(one, qs)) if isinstance(qs, list) else one(qs)


def reduce_group(group: Group, over: set[str], op: str, keep: dict[str, Column] | None = None, **how) -> Group:
    """Reduce the dimensions `over` of a group; `keep` adds plain aggregates."""
    left = tuple(d for d in group.dims if d not in over)
    order = [pos(d) for d in group.dims if d in over]
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    made = {n: aggregate(op, F.col(n), group.kinds[n], at=at, **how) for n in group.exprs}
    columns = [c.alias(n) for n, (c, _) in made.items()] + [c.alias(n) for n, c in (keep or {}).items()]
    keys = group.keys(*over)
    frame = group.frame()
    df = frame.groupBy(*keys).agg(*columns) if keys else frame.agg(*columns)
    return Group(left, df, {n: F.col(n) for n in made}, {n: k for n, (_, k) in made.items()})


def quantile_group(group: Group, dim: str, qs: list[float] | float, method: str, skipna: bool | None) -> tuple[Group, int | None]:
    """A list of quantiles adds a leading dimension `quantile`."""
    if not isinstance(qs, (list, tuple)):
        return reduce_group(group, {dim}, "quantile", q=(float(qs), method), skipna=skipna), None
    qs = [float(q) for q in qs]
    arrays = reduce_group(group, {dim}, "quantile", q=(qs, method), skipna=skipna)
    df = arrays.df
    levels = F.array(*map(F.lit, qs))
    spread = df.select("*", F.posexplode(levels).alias(pos("quantile"), "quantile"))
    names = list(arrays.exprs)
    out = spread.select(pos("quantile"), "quantile", *arrays.keys(), *(F.get(F.col(n), F.col(pos("quantile"))).alias(n) for n in names))
    return Group.of(("quantile", *arrays.dims), out, names), len(qs)
