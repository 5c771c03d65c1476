"""Selection by position and label, reindexing, sorting and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import as_column
from ..plans.positions import neighbours, number_sorted
from ..plans.windows import pos
from ..schema import Group

METHODS = ("nearest", "pad", "ffill", "backfill", "bfill")


def take_slice(group: Group, dim: str, start: int, stop: int, step: int = 1) -> Group:
    """Positions start, start + step, ... before stop, renumbered."""
    p = F.col(pos(dim))
    inside = (p >= start) & (p < stop)
    if step != 1:
        inside = inside & ((p - start) % step == 0)
    df = group.frame().where(inside).withColumn(pos(dim), F.floor((p - start) / step) if step != 1 else p - start)
    return Group(group.dims, df, {n: F.col(n) for n in group.exprs}, group.kinds)


def take_reversed(group: Group, dim: str, picked: range) -> Group:
    """Positions of a range with a negative step."""
    p, lo = F.col(pos(dim)), picked[-1]
    step = -picked.step
    df = group.frame().where((p >= lo) & (p <= picked[0]) & ((picked[0] - p) % step == 0)).withColumn(pos(dim), F.floor((picked[0] - p) / step))
    return Group(group.dims, df, {n: F.col(n) for n in group.exprs}, group.kinds)


def take_one(group: Group, dim: str, at: int) -> Group:
    df = group.frame().where(F.col(pos(dim)) == at).drop(pos(dim), dim)
    return Group(tuple(d for d in group.dims if d != dim), df, {n: F.col(n) for n in group.exprs}, group.kinds)


def take_map(group: Group, dim: str, mapping: DataFrame, fill: object, n_missing: bool, label_type: str | None = None) -> Group:
    """Re-key along dim: mapping (new position, new label, old position or missing). Missing ones get `fill`."""
    frame, names = group.frame(), list(group.exprs)
    to = mapping.select(F.col("new").alias("__n"), F.col("label").alias("__lab"), F.col("old").alias(pos(dim)))
    others = group.keys(dim)
    if not n_missing:
        df = frame.drop(dim).join(to, pos(dim)).drop(pos(dim)).withColumnsRenamed({"__n": pos(dim), "__lab": dim})
        return Group(group.dims, df.select(*group.keys(), *names), {n: F.col(n) for n in names}, group.kinds)
    grid = to.crossJoin(frame.select(*others).distinct()) if others else to
    marked = frame.drop(dim, *(d for d in group.dims if d != dim)).withColumn("__there", F.lit(True))
    joined = grid.join(marked, [pos(dim), *(pos(d) for d in group.dims if d != dim)], "left").drop(pos(dim)).withColumnsRenamed({"__n": pos(dim), "__lab": dim})
    kinds = {n: "float" if k == "int" and (fill is None or isinstance(fill, float)) else k for n, k in group.kinds.items()}
    for n in names:
        c = F.col(n).cast("double") if kinds[n] != group.kinds[n] else F.col(n)
        joined = joined.withColumn(n, c if fill is None else F.when(F.col("__there"), c).otherwise(as_column(fill)))
    return Group(group.dims, joined.select(*group.keys(), *names), {n: F.col(n) for n in names}, kinds)


def match_labels(coord: DataFrame, wanted: DataFrame, method: str | None, tolerance: object | None, n: int, block: int) -> DataFrame:
    """wanted (new, label) with `old`: the position in coord (label, old) that each label means, or missing.

    Exact matches join; the others look up the nearest label at or before (pad,
    ffill), at or after (backfill, bfill) or on either side (nearest: the larger
    label on a tie). n: labels in both tables; beyond `block` these are looked up in ranges.
    """
    if method is None:
        return wanted.join(coord, "label", "left").select("new", "label", "old")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    told = neighbours(coord, wanted, n, block)
    far = lambda a, b: _distance(a, b, dict(coord.dtypes)["label"])
    below, above = far("label", "lo.label"), far("hi.label", "label")
    if method in ("pad", "ffill"):
        pick = F.col("lo")
    elif method in ("backfill", "bfill"):
        pick = F.col("hi")
    else:
        pick = F.when(F.col("lo").isNull() | (above <= below), F.col("hi")).otherwise(F.col("lo"))
        pick = F.coalesce(pick, F.col("lo"))
    told = told.withColumn("__pick", pick)
    if tolerance is not None:
        told = told.withColumn("__pick", F.when(F.abs(far("label", "__pick.label")) <= as_column(tolerance), F.col("__pick")))
    return told.select("new", "label", F.col("__pick.old").alias("old"))


def _distance(a: str, b: str, kind: str) -> Column:
    if kind.startswith(("timestamp", "date")):
        return F.timestamp_diff("MICROSECOND", F.col(b).cast("timestamp_ntz"), F.col(a).cast("timestamp_ntz"))
    return F.col(a).cast("double") - F.col(b).cast("double")


def sort_mapping(keyed: DataFrame, keys: list[str], ascending: bool, n: int, block: int) -> DataFrame:
    """keyed (old, label, keys...) numbered in stable ascending order, missing keys last; descending is that order reversed."""
    order = [*(F.asc_nulls_last(k) if ascending else F.desc_nulls_first(k) for k in keys), F.asc("old") if ascending else F.desc("old")]
    return number_sorted(keyed, order, "new", n, block).select("new", "label", "old")
