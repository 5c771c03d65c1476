"""Group-by on labels, resampling of time, and weighted reductions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elementwise import divide
from ..plans.positions import coordinate
from ..plans.windows import pos
from ..schema import Group
from .reductions import aggregate

GROUP_OPS = ("sum", "mean", "count", "min", "max")
FIXED = {"us": 1, "ms": 10**3, "s": 10**6, "S": 10**6, "min": 60 * 10**6, "T": 60 * 10**6, "h": 3600 * 10**6, "H": 3600 * 10**6, "D": 86_400 * 10**6, "d": 86_400 * 10**6}
CALENDAR = {"W": "W", "W-SUN": "W", "ME": "ME", "M": "ME", "MS": "MS", "QE": "QE", "Q": "QE", "QS": "QS", "YE": "YE", "Y": "YE", "A": "YE", "YS": "YS", "AS": "YS"}


def group_by(group: Group, dim: str, label: Column, op: str, into: str, skipna: bool | None, block: int) -> tuple[Group, int]:
    """Reduce within equal labels along dim; the result has dimension `into` with the sorted distinct labels. Rows whose label is missing are left out."""
    if op not in GROUP_OPS:
        raise ValueError(f"grouped reductions are {GROUP_OPS}, not {op!r}")
    frame = group.frame().withColumn("__label", label).where(F.col("__label").isNotNull())
    made = {n: aggregate(op, F.col(n), group.kinds[n], skipna=skipna) for n in group.exprs}
    keys = group.keys(dim)
    df = frame.groupBy("__label", *keys).agg(*(c.alias(n) for n, (c, _) in made.items())).withColumnRenamed("__label", into)
    at, n = coordinate(df, into, block)
    out = df.join(at, into)
    dims = tuple(into if d == dim else d for d in group.dims)
    return Group(dims, out, {k: F.col(k) for k in made}, {k: kind for k, (_, kind) in made.items()}), n


def parse_frequency(freq: str) -> tuple[int, str]:
    m = re.fullmatch(r"(-?\d*)([A-Za-z]+(?:-[A-Z]{3})?)", freq.strip())
    if not m or m[2] not in FIXED and m[2] not in CALENDAR:
        raise ValueError(f"unknown frequency {freq!r}")
    n = int(m[1]) if m[1] not in ("", "-") else 1
    if n <= 0 or m[1] == "-":
        raise ValueError("a frequency must be positive")
    return n, m[2]


def _months(label: Column) -> Column:
    return F.year(label) * 12 + F.month(label) - 1


def time_bins(ts: Column, freq: str, first: dt.datetime) -> Column:
    """The bin label of each timestamp; `first` is the earliest timestamp of the whole array.

    Fixed lengths count from the midnight before `first` and are labelled by
    their start. Weeks end on Sunday; W, ME, QE and YE are labelled by their last
    day, MS, QS and YS by their first. Multiples count from the first bin.
    """
    n, unit = parse_frequency(freq)
    if unit in FIXED:
        anchor = F.lit(dt.datetime.combine(first.date(), dt.time())).cast("timestamp_ntz")
        step = n * FIXED[unit]
        past = F.timestamp_diff("MICROSECOND", anchor, ts.cast("timestamp_ntz"))
        return F.timestamp_add("MICROSECOND", F.floor(past / step).cast("long") * step, anchor)
    unit = CALENDAR[unit]
    start = F.lit(first).cast("timestamp_ntz")
    if unit == "W":
        label = lambda c: F.date_add(F.date_trunc("week", c).cast("date"), 6)
        own, base = label(ts), label(start)
        out = F.date_add(base, (F.ceil(F.date_diff(own, base) / 7 / n) * n * 7).cast("int")) if n > 1 else own
        return out.cast("timestamp_ntz")
    length = {"M": 1, "Q": 3, "Y": 12}[unit[0]]
    own = F.floor(_months(ts) / length)
    base = F.floor(_months(start) / length)
    ends = unit.endswith("E")
    steps = (F.ceil((own - base) / n) if ends else F.floor((own - base) / n)) * n
    month = ((base + steps) * length).cast("int")
    begin = F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))
    return (F.last_day(F.add_months(begin, length - 1)) if ends else begin).cast("timestamp_ntz")


def fill_gaps(group: Group, dim: str, freq: str, count_like: set[str]) -> tuple[Group, int]:
    """Bins without rows between the first and the last: 0 for counts and sums, else missing. Fixed lengths only."""
    n, unit = parse_frequency(freq)
    if unit not in FIXED:
        raise NotImplementedError("gaps are filled for fixed-length bins")
    frame, step = group.frame(), n * FIXED[unit]
    ends = frame.agg(F.min(dim).alias("a"), F.max(dim).alias("b")).first()
    if ends["a"] is None:
        return group, 0
    total = int((ends["b"] - ends["a"]) / dt.timedelta(microseconds=step)) + 1
    axis = frame.sparkSession.range(total).select(F.col("id").alias(pos(dim)), F.timestamp_add("MICROSECOND", F.col("id") * step, F.lit(ends["a"]).cast("timestamp_ntz")).alias(dim))
    others = [c for c in group.keys(dim)]
    grid = axis.crossJoin(frame.select(*others).distinct()) if others else axis
    out = grid.join(frame.drop(pos(dim)), [dim, *others], "left")
    for v in count_like:
        out = out.withColumn(v, F.coalesce(v, F.lit(0)))
    return Group(group.dims, out, {k: F.col(k) for k in group.exprs}, group.kinds), total


def weighted(group: Group, over: set[str], weight: Column, op: str, skipna: bool | None, frame: DataFrame) -> Group:
    """sum_of_weights, sum and mean with a weight column of `frame`."""
    keys = group.keys(*over)
    columns, names = [], list(group.exprs)
    for n in names:
        v, w = F.col(n).cast("double"), weight.cast("double")
        skip = skipna is None or skipna
        product = F.sum(v * w)
        total = F.coalesce(product, F.lit(0.0)) if skip else F.when(F.count(v * w) == F.count(F.lit(1)), product)
        weights = F.when(F.count(w) == F.count(F.lit(1)), F.coalesce(F.sum(F.when(v.isNotNull(), w).otherwise(0.0)), F.lit(0.0)))
        value = {"sum_of_weights": weights, "sum": total, "mean": divide(total, F.when(weights != 0, weights))}[op]
        columns.append(value.alias(n))
    df = frame.groupBy(*keys).agg(*columns) if keys else frame.agg(*columns)
    return Group(tuple(d for d in group.dims if d not in over), df, {n: F.col(n) for n in names}, dict.fromkeys(names, "float"))
