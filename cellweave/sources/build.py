"""Arrays from fill functions, from NumPy, and empty ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Lattice
from ..functions.elementwise import no_nan
from ..plans.blocks import compute_domains
from ..plans.windows import Layout, pos
from ..schema import Group, Meta

TYPES = {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "short", "i1": "byte", "b1": "boolean"}


def spark_type(dtype: object) -> str:
    d = np.dtype(dtype)
    if d.kind == "u":
        return {1: "short", 2: "int", 4: "long", 8: "decimal(20,0)"}[d.itemsize]
    try:
        return TYPES[f"{d.kind}{d.itemsize}"]
    except KeyError:
        raise TypeError(f"no column type for {d}") from None


def _labels(spark: SparkSession, df: DataFrame, dims: Sequence[str], coords: dict[str, Sequence] | None, sizes: dict[str, int]) -> DataFrame:
    for d in dims:
        if coords and d in coords:
            values = [v.item() if isinstance(v, np.generic) and not isinstance(v, np.datetime64) else v.astype("datetime64[us]").item() if isinstance(v, np.datetime64) else v for v in coords[d]]
            if len(values) != sizes[d]:
                raise ValueError(f"{d!r} has {sizes[d]} cells and {len(values)} labels")
            kind = "timestamp_ntz" if values and hasattr(values[0], "year") and hasattr(values[0], "hour") else None
            table = spark.createDataFrame(list(enumerate(values)), f"`{pos(d)}` long, `{d}` {kind}" if kind else [pos(d), d]) if values else spark.createDataFrame([], f"`{pos(d)}` long, `{d}` double")
            df = df.join(table, pos(d))
        else:
            df = df.withColumn(d, F.col(pos(d)))
    return df


def from_fill(
    spark: SparkSession, fill: Callable, dims: Sequence[str], shape: Sequence[int], *, dim: str | int = 0, dtype: object = "f8", coords: dict[str, Sequence] | None = None,
    name: str = "v", attrs: dict | None = None, blocks: int | None = None, min_partition_size: int | None = None, layout: Layout = Layout(),
) -> Lattice:
    """An array filled block by block on the executors, or by a column expression.

    fill(start, stop) gives the values of positions [start, stop) of `dim` with
    all other dimensions whole; it is called once per block, where the block's
    task runs. A Column over positions needs no Python on the executors.
    """
    dims, shape = list(dims), list(shape)
    sizes = dict(zip(dims, map(int, shape), strict=True))
    kind = spark_type(dtype)
    if isinstance(fill, Column):
        total = math.prod(sizes.values())
        df, stride = spark.range(total), total
        for d in dims:
            stride = stride // sizes[d] if sizes[d] else 0
            df = df.withColumn(pos(d), F.floor(F.col("id") / max(stride, 1)) % max(sizes[d], 1))
        value = fill.cast(kind)
        df = df.select(*(pos(d) for d in dims), (no_nan(value) if kind in ("double", "float") else value).alias(name))
    else:
        d0 = dims[dim] if isinstance(dim, int) else dim
        axis, n = dims.index(d0), blocks or spark.sparkContext.defaultParallelism
        bounds = [(i, a, b) for i, (a, b) in enumerate(compute_domains(sizes[d0], n, min_partition_size)) if b > a]
        rest = [sizes[d] for d in dims]
        schema = ", ".join([*(f"`{pos(d)}` long" for d in dims), f"`{name}` {kind}"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for a, b in zip(batch["a"], batch["b"], strict=True):
                    want = tuple(b - a if i == axis else s for i, s in enumerate(rest))
                    values = np.asarray(fill(int(a), int(b))).astype(dtype)
                    if values.shape != want:
                        raise ValueError(f"fill gave shape {values.shape}, not {want}")
                    at = np.indices(want).reshape(len(want), -1)
                    at[axis] += a
                    yield pd.DataFrame({pos(d): at[i] for i, d in enumerate(dims)} | {name: values.ravel()})

        table = spark.createDataFrame(bounds, "i long, a long, b long").repartition(max(1, len(bounds)), "i") if bounds else spark.createDataFrame([], "i long, a long, b long")
        df = table.mapInPandas(run, schema)
        if kind in ("double", "float"):
            df = df.withColumn(name, no_nan(F.col(name)))
    df = _labels(spark, df, dims, coords, sizes).select(*(c for d in dims for c in (pos(d), d)), name)
    return Lattice([Group.of(tuple(dims), df, [name])], Meta(sizes, frozenset(coords or ()), dict(attrs or {})), layout, name)


def from_numpy(spark: SparkSession, values: np.ndarray, dims: Sequence[str], *, coords: dict[str, Sequence] | None = None, name: str = "v", attrs: dict | None = None, partitions: int | None = None, layout: Layout = Layout()) -> Lattice:
    """An array the driver holds, dealt out by its longest dimension."""
    values = np.asarray(values)
    dims = list(dims)
    if values.ndim != len(dims):
        raise ValueError(f"{values.ndim} dimensions and {len(dims)} names")
    sizes = dict(zip(dims, values.shape, strict=True))
    at = np.indices(values.shape).reshape(values.ndim, -1) if values.ndim else np.empty((0, 1), int)
    kind = spark_type(values.dtype)
    pdf = pd.DataFrame({pos(d): at[i] for i, d in enumerate(dims)} | {name: values.ravel()})
    df = spark.createDataFrame(pdf, ", ".join([*(f"`{pos(d)}` long" for d in dims), f"`{name}` {kind}"]))
    if kind in ("double", "float"):
        df = df.withColumn(name, no_nan(F.col(name)))
    if partitions and dims:
        longest = max(dims, key=lambda d: sizes[d])
        df = df.repartitionByRange(partitions, pos(longest))
    df = _labels(spark, df, dims, coords, sizes).select(*(c for d in dims for c in (pos(d), d)), name)
    return Lattice([Group.of(tuple(dims), df, [name])], Meta(sizes, frozenset(coords or ()), dict(attrs or {})), layout, name)


def from_dict(spark: SparkSession, variables: dict[str, tuple[Sequence[str], object]], sizes: dict[str, int] | None = None, *, dim: str | None = None, coords: dict[str, Sequence] | None = None, attrs: dict | None = None, dtypes: dict[str, object] | None = None) -> Lattice:
    """A set of variables: each (dims, array), (dims, fill function or Column), or another single-variable array."""
    groups, all_sizes, labelled = [], dict(sizes or {}), set(coords or ())
    for name, spec in variables.items():
        if isinstance(spec, Lattice):
            one = spec.rename_vars({spec._one(): name})
        else:
            dims, source = spec
            own = {d: c for d, c in (coords or {}).items() if d in dims}
            if isinstance(source, Column) or callable(source):
                one = from_fill(spark, source, dims, [all_sizes[d] for d in dims], dim=dim if dim in dims else 0, dtype=(dtypes or {}).get(name, "f8"), coords=own, name=name)
            else:
                one = from_numpy(spark, np.asarray(source), dims, coords=own, name=name)
        for d, n in one.sizes.items():
            if all_sizes.setdefault(d, n) != n:
                raise ValueError(f"{name!r} has {n} cells along {d!r}, others {all_sizes[d]}")
        groups += one._groups
        labelled |= one._meta.labelled
    return Lattice(groups, Meta(all_sizes, frozenset(labelled), dict(attrs or {})))


def empty(spark: SparkSession) -> Lattice:
    """No variables and no dimensions."""
    return Lattice([], Meta({}))


def is_empty(data: Lattice) -> bool:
    return not data._groups or all(n == 0 for n in data.sizes.values()) and bool(data.sizes)
