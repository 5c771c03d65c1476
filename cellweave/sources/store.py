"""Native storage: one Parquet table per tuple of dimensions and a JSON description.

Tables are ordered by position, so that slices of a dimension prune row groups;
appending records along one dimension adds files and rewrites the description.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import Lattice
from ..plans.windows import Layout, pos
from ..schema import Group, Meta


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    stream = fs.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def _folder(dims: tuple[str, ...]) -> str:
    return "by_" + "_".join(dims) if dims else "scalars"


def _description(data: Lattice, unlimited: list[str]) -> str:
    groups = [{"dims": list(g.dims), "variables": list(g.exprs), "kinds": g.kinds} for g in data._groups]
    meta = data._meta
    return json.dumps({"sizes": meta.sizes, "labelled": sorted(meta.labelled), "attrs": meta.attrs, "var_attrs": meta.var_attrs, "encoding": meta.encoding, "unlimited": unlimited, "groups": groups}, indent=1)


def _merged(data: Lattice) -> list[Group]:
    """One group per tuple of dimensions."""
    by_dims: dict[tuple[str, ...], list[Group]] = {}
    for g in data._groups:
        by_dims.setdefault(g.dims, []).append(g)
    out = []
    for dims, groups in by_dims.items():
        df = groups[0].frame()
        for more in groups[1:]:
            df = df.join(more.frame().drop(*dims), [pos(d) for d in dims]) if dims else df.crossJoin(more.frame())
        out.append(Group.of(dims, df, [n for g in groups for n in g.exprs], {n: k for g in groups for n, k in g.kinds.items()}))
    return out


def write(data: Lattice, path: str, *, dim: str = "auto", partitions: int | None = None, unlimited: list[str] | None = None) -> None:
    """Write all variables, in slabs of one dimension; an existing store is replaced."""
    if unknown := set(unlimited or ()) - set(data.sizes):
        raise ValueError(f"no dimensions {sorted(unknown)}")
    spark, told = None, []
    for g in _merged(data):
        dims, df = g.dims, g.df
        spark = df.sparkSession
        told.append(g)
        if dims:
            slab = data.partition_dim() if dim == "auto" else dim
            slab = slab if slab in dims else max(dims, key=lambda d: data.sizes[d])
            df = df.repartitionByRange(*([partitions] if partitions else []), pos(slab)).sortWithinPartitions(pos(slab), *(pos(d) for d in dims if d != slab))
        df.write.mode("overwrite").parquet(f"{path}/{_folder(dims)}")
    if spark is None:
        raise ValueError("there is nothing to write")
    _write_text(spark, f"{path}/description.json", _description(Lattice(told, data._meta), list(unlimited or ())))


def read(spark: SparkSession, path: str, *, layout: Layout = Layout()) -> Lattice:
    """Open a store lazily; only variables and positions that are asked for get read."""
    told = json.loads(_read_text(spark, f"{path}/description.json"))
    groups = [Group.of(tuple(g["dims"]), spark.read.parquet(f"{path}/{_folder(tuple(g['dims']))}"), g["variables"], g["kinds"]) for g in told["groups"]]
    meta = Meta(told["sizes"], frozenset(told["labelled"]), told["attrs"], told["var_attrs"], told["encoding"])
    names = [n for g in groups for n in g.exprs]
    return Lattice(groups, meta, layout, names[0] if len(names) == 1 else None)


def append(data: Lattice, path: str, dim: str = "time") -> None:
    """Append records along an unlimited dimension; variables without it are left as they are."""
    if dim not in data.sizes:
        raise ValueError(f"the data have no dimension {dim!r}")
    spark = data._groups[0].df.sparkSession
    told = json.loads(_read_text(spark, f"{path}/description.json"))
    if dim not in told["sizes"]:
        raise ValueError(f"the store has no dimension {dim!r}")
    if dim not in told["unlimited"]:
        raise ValueError(f"{dim!r} is not unlimited in the store")
    for d, n in data.sizes.items():
        if d != dim and told["sizes"].get(d) != n:
            raise ValueError(f"{d!r} has {n} cells, in the store {told['sizes'].get(d)}")
    old, names = told["sizes"][dim], {n for g in data._groups for n in g.exprs}
    for g in told["groups"]:
        if dim in g["dims"]:
            if missing := set(g["variables"]) - names:
                raise ValueError(f"the data lack {sorted(missing)}")
            own = next(x for x in _merged(data) if set(g["variables"]) <= set(x.exprs))
            there = spark.read.parquet(f"{path}/{_folder(tuple(g['dims']))}")
            df = own.frame().withColumn(pos(dim), F.col(pos(dim)) + old)
            df.select(*(F.col(f.name).cast(f.dataType) for f in there.schema.fields)).write.mode("append").parquet(f"{path}/{_folder(tuple(g['dims']))}")
    told["sizes"][dim] = old + data.sizes[dim]
    _write_text(spark, f"{path}/description.json", json.dumps(told, indent=1))
