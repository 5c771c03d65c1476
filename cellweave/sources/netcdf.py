"""Classic NetCDF files (CDF-1, CDF-2 and CDF-5) as a Spark data source, in NumPy.

The driver reads the header and plans one input partition per slab of the first
dimension; each task reads its slab through Spark's own file access, so a path
may lie in any store. Files are written by one task, as the format is a single
file; the parallel way to store arrays is cellweave.sources.store.

HDF5-based NetCDF-4 files need a library that this package does not carry.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import Lattice
from ..functions.elementwise import no_nan
from ..plans.blocks import compute_domains
from ..plans.windows import Layout, pos
from ..schema import Group, Meta

# Fixed values of the classic file format: type codes with their NumPy types, and list tags.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
# Default fill values by type.
FILL = {">i1": -127, ">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, ">u1": 255, ">u2": 65535, ">u4": 4294967295, ">i8": -9223372036854775806, ">u8": 18446744073709551614}
UNIT_US = {"microseconds": 1, "milliseconds": 10**3, "seconds": 10**6, "minutes": 60 * 10**6, "hours": 3600 * 10**6, "days": 86_400 * 10**6}


class NetCDFError(ValueError):
    """A file or an array that the classic format can't hold."""


@dataclass
class Variable:
    name: str
    dims: list[int]
    attrs: dict[str, object]
    dtype: str
    begin: int = 0
    vsize: int = 0


@dataclass
class Header:
    version: int
    records: int
    dims: list[tuple[str, int]]  # length 0: the record dimension
    attrs: dict[str, object]
    variables: list[Variable] = field(default_factory=list)

    def length(self, i: int) -> int:
        return self.dims[i][1] or self.records

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.length(i) for i in v.dims)

    def record_size(self) -> int:
        """Bytes of one record; a lone record variable isn't padded."""
        own = [v for v in self.variables if self.is_record(v)]
        sizes = [math.prod(self.shape(v)[1:]) * np.dtype(v.dtype).itemsize for v in own]
        return sizes[0] if len(own) == 1 else sum(-(-s // 4) * 4 for s in sizes)


class _Reader:
    def __init__(self, data: bytes, version: int):
        self.data, self.at, self.wide = data, 4, version == 5
        self.far = version in (2, 5)

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def count(self) -> int:
        return int.from_bytes(self.take(8 if self.wide else 4), "big")

    def tag(self) -> int:
        return int.from_bytes(self.take(4), "big")

    def offset(self) -> int:
        return int.from_bytes(self.take(8 if self.far else 4), "big")

    def name(self) -> str:
        n = self.count()
        out = self.take(n).decode()
        self.take(-n % 4)
        return out

    def attributes(self) -> dict[str, object]:
        self.tag()
        out = {}
        for _ in range(self.count()):
            name, kind, n = self.name(), TYPES[self.tag()], self.count()
            size = np.dtype(kind).itemsize * n
            raw = self.take(size)
            self.take(-size % 4)
            if kind == "S1":
                out[name] = raw.decode("utf-8", "replace").rstrip("\0")
            else:
                values = np.frombuffer(raw, kind)
                out[name] = values[0].item() if n == 1 else values.tolist()
        return out


def parse_header(data: bytes) -> Header:
    if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
        raise NetCDFError("not a classic NetCDF file" + (" (HDF5-based files are not supported)" if data[1:4] == b"HDF" else ""))
    r = _Reader(data, data[3])
    records = r.count()
    r.tag()
    dims = [(r.name(), r.count()) for _ in range(r.count())]
    header = Header(data[3], records, dims, r.attributes())
    r.tag()
    for _ in range(r.count()):
        name = r.name()
        ids = [r.count() for _ in range(r.count())]
        attrs = r.attributes()
        header.variables.append(Variable(name, ids, attrs, TYPES[r.tag()], vsize=r.count(), begin=r.offset()))
    return header


class _File:
    """Random access to a file of any store, through Hadoop's file systems on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm, self._spark = jvm, spark

    def head(self, n: int) -> bytes:
        size = min(n, self._fs.getFileStatus(self._path).getLen())
        stream = self._fs.open(self._path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
        finally:
            stream.close()

    def write(self, data: bytes) -> None:
        stream = self._fs.create(self._path, True)
        for at in range(0, len(data), 1 << 22):
            stream.write(bytearray(data[at : at + (1 << 22)]))
        stream.close()


def read_header(spark: SparkSession, path: str) -> Header:
    size, f = 1 << 16, _File(spark, path)
    while True:
        data = f.head(size)
        try:
            return parse_header(data)
        except EOFError:
            if len(data) < size:
                raise NetCDFError(f"{path} ends within its header") from None
            size *= 4


def _unpack(values: np.ndarray, attrs: dict[str, object]) -> np.ndarray:
    """Fill values become missing, scale and offset are applied."""
    missing = np.zeros(values.shape, bool)
    for key in ("_FillValue", "missing_value"):
        if key in attrs:
            missing |= values == attrs[key]
    if "scale_factor" in attrs or "add_offset" in attrs or missing.any():
        values = values.astype("f8") * attrs.get("scale_factor", 1) + attrs.get("add_offset", 0)
        values[missing] = np.nan
    return values


def _times(attrs: dict[str, object]) -> tuple[int, pd.Timestamp] | None:
    """Microseconds per unit and the origin of a CF time coordinate in a standard calendar."""
    units = attrs.get("units")
    if not isinstance(units, str) or " since " not in units or str(attrs.get("calendar", "standard")) not in ("standard", "gregorian", "proleptic_gregorian"):
        return None
    unit, origin = units.split(" since ", 1)
    unit = unit if unit in UNIT_US else unit + "s"
    return (UNIT_US[unit], pd.Timestamp(origin)) if unit in UNIT_US else None


def _slab(data: bytes | np.ndarray, header: Header, v: Variable, a: int, b: int) -> np.ndarray:
    """Values of positions [a, b) of the first dimension, from the whole file's bytes or a map of it."""
    kind, shape = np.dtype(v.dtype), header.shape(v)
    if not v.dims:
        return np.frombuffer(data, kind, 1, v.begin).reshape(())
    inner = math.prod(shape[1:])
    if not header.is_record(v):
        return np.frombuffer(data, kind, (b - a) * inner, v.begin + a * inner * kind.itemsize).reshape(b - a, *shape[1:])
    step = header.record_size()
    rows = [np.frombuffer(data, kind, inner, v.begin + i * step) for i in range(a, b)]
    return (np.stack(rows) if rows else np.empty((0, inner), kind)).reshape(b - a, *shape[1:])


def open_dataset(spark: SparkSession, path: str | list[str], *, variables: list[str] | None = None, partitions: int | None = None, layout: Layout = Layout()) -> Lattice:
    """Open classic NetCDF files lazily. Several files (a list, or a path with *) join along their first dimension, in order of its labels.

    Coordinate variables (one-dimensional, named like their dimension) become
    labels, CF times become timestamps. Character variables are left out.
    """
    if isinstance(path, str) and "*" in path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        path = sorted(str(s.getPath().toString()) for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))
    if isinstance(path, (list, tuple)):
        if not path:
            raise FileNotFoundError("no file matches")
        return _joined([open_dataset(spark, p, variables=variables, partitions=partitions, layout=layout) for p in path])
    header = read_header(spark, path)
    names = [d for d, _ in header.dims]
    coords = {v.name: v for v in header.variables if len(v.dims) == 1 and names[v.dims[0]] == v.name and v.dtype != "S1"}
    wanted = [v for v in header.variables if v.name not in coords and v.dtype != "S1" and (variables is None or v.name in variables)]
    if variables and (missing := set(variables) - {v.name for v in wanted}):
        raise KeyError(f"no variables {sorted(missing)}")
    file = spark.read.format("binaryFile").load(path).select("content")
    n = partitions or spark.sparkContext.defaultParallelism
    by_dims: dict[tuple[int, ...], list[Variable]] = {}
    for v in wanted:
        by_dims.setdefault(tuple(v.dims), []).append(v)
    groups = []
    for ids, own in by_dims.items():
        dims = [names[i] for i in ids]
        length = header.length(ids[0]) if ids else 1
        kinds = {v.name: ("double" if {"_FillValue", "missing_value", "scale_factor", "add_offset"} & set(v.attrs) else {"f8": "double", "f4": "float", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "double"}[v.dtype[1:]]) for v in own}
        labels = {d: coords[d] for d in dims if d in coords}
        times = {d: _times(v.attrs) for d, v in labels.items()}
        label_type = {d: "timestamp_ntz" if times.get(d) else "double" if d in labels and np.dtype(labels[d].dtype).kind == "f" else "long" for d in dims}
        schema = ", ".join([*(f"`{c}` {t}" for d in dims for c, t in ((pos(d), "long"), (d, label_type[d]))), *(f"`{k}` {t}" for k, t in kinds.items())])

        def run(batches, dims=dims, ids=ids, own=own, labels=labels, times=times):
            for batch in batches:
                for content, a, b in zip(batch["content"], batch["a"], batch["b"], strict=True):
                    shape = ((int(b - a), *(header.length(i) for i in ids[1:])) if ids else ())
                    at = np.indices(shape).reshape(len(shape), -1)
                    out = {}
                    for i, d in enumerate(dims):
                        p = at[i] + (a if i == 0 else 0)
                        out[pos(d)] = p
                        if d in labels:
                            whole = _slab(content, header, labels[d], 0, header.length(ids[i]))
                            if times[d]:
                                unit, origin = times[d]
                                whole = (np.round(whole.astype("f8") * unit) if whole.dtype.kind == "f" else whole.astype("i8") * unit).astype("i8").astype("timedelta64[us]") + np.datetime64(origin.to_datetime64(), "us")
                                out[d] = whole[p]
                            else:
                                out[d] = whole.astype(whole.dtype.newbyteorder("="))[p]
                        else:
                            out[d] = p
                    for v in own:
                        x = _unpack(_slab(content, header, v, int(a), int(b)), v.attrs)
                        out[v.name] = x.astype(x.dtype.newbyteorder("=")).ravel()
                    yield pd.DataFrame(out)

        bounds = [(a, b) for a, b in compute_domains(length, n) if b > a] or [(0, 0)]
        slabs = spark.createDataFrame(bounds, "a long, b long").repartition(len(bounds), "a")
        df = slabs.crossJoin(file).mapInPandas(run, schema)
        for k, t in kinds.items():
            if t in ("double", "float"):
                df = df.withColumn(k, no_nan(F.col(k)))
        groups.append(Group.of(tuple(dims), df, list(kinds)))
    sizes = {d: header.length(i) for i, (d, _) in enumerate(header.dims)}
    used = {d for g in groups for d in g.dims}
    keep = {"_FillValue", "scale_factor", "add_offset", "units", "calendar", "missing_value"}
    meta = Meta(
        {d: n for d, n in sizes.items() if d in used}, frozenset(d for d in coords if d in used), header.attrs,
        {v.name: {k: x for k, x in v.attrs.items() if k not in keep} for v in wanted}, {v.name: {k: x for k, x in v.attrs.items() if k in keep} | {"dtype": v.dtype[1:]} for v in (*wanted, *coords.values())},
    )
    return Lattice(groups, meta, layout, wanted[0].name if len(wanted) == 1 else None)


def _joined(parts: list[Lattice]) -> Lattice:
    first = parts[0]
    dim = next(iter(first.sizes))
    groups = []
    for g in first._groups:
        own = [next(x for x in p._groups if set(g.exprs) <= set(x.exprs)) for p in parts]
        if dim not in g.dims:
            groups.append(g)
            continue
        keyed, at = None, 0
        for p, x in zip(parts, own, strict=True):
            df = x.frame().withColumn(pos(dim), F.col(pos(dim)) + at)
            keyed, at = df if keyed is None else keyed.unionByName(df), at + p.sizes[dim]
        groups.append(Group.of(g.dims, keyed, list(g.exprs), g.kinds))
    out = first._new(groups, first.sizes | {dim: sum(p.sizes[dim] for p in parts)})
    return out.sortby(dim) if dim in out._meta.labelled else out


# -- writing ---------------------------------------------------------------------


def _text(value: str, wide: bool) -> bytes:
    raw = value.encode()
    return len(raw).to_bytes(8 if wide else 4, "big") + raw + b"\0" * (-len(raw) % 4)


def _attribute_list(attrs: dict[str, object], wide: bool) -> bytes:
    n = len(attrs)
    count = lambda k: k.to_bytes(8 if wide else 4, "big")
    out = (struct.pack(">I", ATTRIBUTE) if n else struct.pack(">I", 0)) + count(n)
    for key, value in attrs.items():
        out += _text(key, wide)
        if isinstance(value, str):
            raw = value.encode()
            out += struct.pack(">I", 2) + count(len(raw)) + raw + b"\0" * (-len(raw) % 4)
            continue
        a = np.atleast_1d(np.asarray(value))
        kind = {"i1": 1, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "i8": 10 if wide else 4, "u1": 7 if wide else 3, "b1": 1}.get(a.dtype.str[1:], 6)
        raw = a.astype(TYPES[kind]).tobytes()
        out += struct.pack(">I", kind) + count(len(a)) + raw + b"\0" * (-len(raw) % 4)
    return out


def encode(dims: list[tuple[str, int]], variables: list[tuple[str, list[str], np.ndarray, dict[str, object]]], attrs: dict[str, object], unlimited: str | None, version: int = 5) -> bytes:
    """A whole file. dims give each length; variables along `unlimited` have it first."""
    if version not in (1, 2, 5):
        raise NetCDFError("versions are 1, 2 and 5")
    wide, far = version == 5, version in (2, 5)
    count = lambda k: int(k).to_bytes(8 if wide else 4, "big")
    index = {d: i for i, (d, _) in enumerate(dims)}
    records = dict(dims).get(unlimited, 0) if unlimited else 0
    codes = {v: k for k, v in TYPES.items() if v != "S1"}
    prepared = []
    for name, own, values, more in variables:
        kind = values.dtype.newbyteorder(">").str.replace("|", ">")
        if kind == ">b1":
            kind = ">i1"
        if kind == ">i8" and not wide and (not values.size or abs(values).max() < 2**31):
            kind = ">i4"
        if kind not in codes or codes[kind] > 6 and not wide:
            raise NetCDFError(f"{name!r}: type {values.dtype} needs another version of the format" if kind in codes else f"{name!r}: type {values.dtype} can't be stored")
        if unlimited in own and own[0] != unlimited:
            raise NetCDFError(f"{name!r}: the unlimited dimension comes first")
        prepared.append((name, own, values.astype(kind), more, codes[kind]))
    head = struct.pack(">I", DIMENSION if dims else 0) + count(len(dims)) + b"".join(_text(d, wide) + count(0 if d == unlimited else n) for d, n in dims) + _attribute_list(attrs, wide)
    pad = lambda n: -(-n // 4) * 4
    recs = [v for v in prepared if unlimited and unlimited in v[1]]
    inner = lambda v: math.prod(v[2].shape[1:]) * v[2].dtype.itemsize
    vsize = lambda v: pad(inner(v)) if v in recs else pad(v[2].nbytes)
    entry = lambda v, begin: _text(v[0], wide) + count(len(v[1])) + b"".join(count(index[d]) for d in v[1]) + _attribute_list(v[3], wide) + struct.pack(">I", v[4]) + count(vsize(v)) + int(begin).to_bytes(8 if far else 4, "big")
    listed = struct.pack(">I", VARIABLE if prepared else 0) + count(len(prepared))
    start = 4 + len(count(0)) + len(head) + len(listed) + sum(len(entry(v, 0)) for v in prepared)
    begins, at = {}, start
    fixed = [v for v in prepared if not any(v is r for r in recs)]
    recs_ = [v for v in prepared if any(v is r for r in recs)]
    for v in fixed:
        begins[v[0]] = at
        at += pad(v[2].nbytes)
    for v in recs_:
        begins[v[0]] = at
        at += inner(v) if len(recs_) == 1 else pad(inner(v))
    if not far and at > 2**31 - 1:
        raise NetCDFError("version 1 holds at most 2 GiB")
    out = [b"CDF" + bytes([version]), count(records), head, listed, *(b"".join([_text(v[0], wide), count(len(v[1])), b"".join(count(index[d]) for d in v[1]), _attribute_list(v[3], wide), struct.pack(">I", v[4]), count(pad(inner(v)) if any(v is r for r in recs_) else pad(v[2].nbytes)), int(begins[v[0]]).to_bytes(8 if far else 4, "big")]) for v in prepared)]
    for v in fixed:
        raw = v[2].tobytes()
        out += [raw, b"\0" * (-len(raw) % 4)]
    for i in range(records):
        for v in recs_:
            raw = v[2][i : i + 1].tobytes()
            out += [raw, b"" if len(recs_) == 1 else b"\0" * (-len(raw) % 4)]
    return b"".join(out)


def _pack(name: str, values: np.ndarray, encoding: dict[str, object]) -> tuple[np.ndarray, dict[str, object]]:
    """Apply dtype, scale, offset and fill value of an encoding; a value that doesn't fit is an error."""
    attrs = {k: encoding[k] for k in ("scale_factor", "add_offset", "units", "calendar") if k in encoding}
    dtype = np.dtype(encoding["dtype"]) if "dtype" in encoding else values.dtype if values.dtype.kind != "O" else np.dtype("f8")
    if values.dtype.kind == "b":
        return values.astype("i1"), attrs | {"dtype": "bool"}
    if values.dtype.kind not in "iuf":
        raise NetCDFError(f"{name!r}: values of type {values.dtype} can't be stored")
    fill = encoding.get("_FillValue")
    x = values.astype("f8") if values.dtype.kind == "f" else values
    missing = np.isnan(x) if x.dtype.kind == "f" else np.zeros(x.shape, bool)
    if "scale_factor" in encoding or "add_offset" in encoding:
        x = (x - encoding.get("add_offset", 0)) / encoding.get("scale_factor", 1)
    if dtype.kind in "iu":
        if fill is None and missing.any():
            fill = FILL[dtype.newbyteorder(">").str.replace("|", ">")]
        whole = np.round(np.where(missing, 0, x))
        limits = np.iinfo(dtype)
        if whole.size and (whole.min() < limits.min or whole.max() > limits.max):
            raise NetCDFError(f"{name!r}: a value does not fit {dtype}")
        packed = whole.astype(dtype)
        if fill is not None:
            packed[missing] = fill
    else:
        packed = x.astype(dtype)
        if fill is not None:
            packed[missing] = fill
    if fill is not None:
        attrs["_FillValue"] = np.asarray(fill, dtype)
    return packed, attrs


def _arrays(data: Lattice, encoding: dict[str, dict]) -> tuple[list[tuple[str, int]], list]:
    dims = list(data.sizes.items())
    out = []
    for d, n in dims:
        if d not in data._meta.labelled:
            continue
        labels = [r[1] for r in data.coordinate(d).orderBy(pos(d)).collect()]
        own = data._meta.encoding.get(d, {}) | encoding.get(d, {})
        if labels and isinstance(labels[0], str):
            raise NetCDFError(f"{d!r}: labels of text can't be stored")
        if labels and hasattr(labels[0], "year"):
            unit, origin = _times(own) or (None, None)
            if unit is None:
                origin = pd.Timestamp(min(labels))
                gaps = {int((pd.Timestamp(x) - origin) / pd.Timedelta(microseconds=1)) for x in labels}
                unit = next(u for u in sorted(UNIT_US.values(), reverse=True) if all(g % u == 0 for g in gaps))
                own = own | {"units": f"{next(k for k, u in UNIT_US.items() if u == unit)} since {origin}", "calendar": "proleptic_gregorian"}
            steps = np.array([(pd.Timestamp(x) - origin) / pd.Timedelta(microseconds=unit) for x in labels])
            values = steps.astype("i8") if (steps == np.round(steps)).all() else steps
            out.append((d, [d], *_pack(d, values, {k: v for k, v in own.items() if k in ("units", "calendar", "dtype")})))
        else:
            out.append((d, [d], *_pack(d, np.array(labels, dtype=None if labels else "f8"), {k: v for k, v in own.items() if k == "dtype"})))
    for name, own in data.variables.items():
        packed, attrs = _pack(name, data.to_numpy(name), data._meta.encoding.get(name, {}) | encoding.get(name, {}))
        out.append((name, list(own), packed, {k: v for k, v in data._meta.var_attrs.get(name, {}).items()} | attrs))
    return dims, out


def write(data: Lattice, path: str, *, unlimited_dim: str | None = None, encoding: dict[str, dict] | None = None, version: int = 5, most_bytes: int = 1 << 30, **ignored: object) -> None:
    """Write one classic file. It passes through the driver, so data larger than most_bytes are refused: store them natively.

    encoding per variable: dtype, scale_factor, add_offset, _FillValue, units,
    calendar. Tuning options of other formats are accepted and ignored.
    """
    if data.nbytes > most_bytes:
        raise NetCDFError(f"{data.nbytes} bytes exceed {most_bytes}; use to_store")
    if unlimited_dim is not None and unlimited_dim not in data.sizes:
        raise ValueError(f"no dimension {unlimited_dim!r}")
    dims, arrays = _arrays(data, encoding or {})
    spark = data._groups[0].df.sparkSession
    _File(spark, path).write(encode(dims, arrays, data.attrs, unlimited_dim, version))


def append(data: Lattice, path: str, dim: str = "time") -> None:
    """Append records along the file's unlimited dimension, in the stored encoding; variables without it are kept, missing ones are an error."""
    spark = data._groups[0].df.sparkSession
    if dim not in data.sizes:
        raise ValueError(f"the data have no dimension {dim!r}")
    header = read_header(spark, path)
    names = dict(header.dims)
    if dim not in names:
        raise ValueError(f"the file has no dimension {dim!r}")
    if names[dim] != 0:
        raise ValueError(f"{dim!r} is not unlimited in the file")
    (content,) = (bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect())
    index = [d for d, _ in header.dims]
    stored = {v.name: v for v in header.variables}
    raw = lambda v: {k: x for k, x in v.attrs.items() if k in ("scale_factor", "add_offset", "_FillValue", "units", "calendar")} | {"dtype": v.dtype[1:]}
    _, fresh = _arrays(data, {n: raw(v) for n, v in stored.items()})
    new = {n: (own, values, attrs) for n, own, values, attrs in fresh}
    out = []
    for v in header.variables:
        own = [index[i] for i in v.dims]
        old = _slab(content, header, v, 0, header.length(v.dims[0]) if v.dims else 1)
        if dim in own:
            if v.name not in new:
                raise ValueError(f"the data lack {v.name!r}")
            more = new[v.name][1].transpose([new[v.name][0].index(d) for d in own])
            old = np.concatenate([old, more.astype(old.dtype)])
        out.append((v.name, own, old, {k: (np.asarray(x, v.dtype) if k == "_FillValue" else x) for k, x in v.attrs.items()}))
    for n, (own, values, attrs) in new.items():
        if n not in stored:
            if dim in own and header.records:
                full = np.full((header.records, *values.shape[1:]), np.nan if values.dtype.kind == "f" else FILL[values.dtype.newbyteorder(">").str.replace("|", ">")], values.dtype)
                values = np.concatenate([full, values])
            out.append((n, own, values, attrs))
    dims = [(d, header.records + data.sizes[dim] if d == dim else n) for d, n in header.dims]
    _File(spark, path).write(encode(dims, out, header.attrs, dim, header.version))
