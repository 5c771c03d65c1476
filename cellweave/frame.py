"""The facade: named variables over labelled dimensions, as one lazy object."""

from __future__ import annotations

import datetime as dt
import math
import operator
from collections.abc import Callable, Iterable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import elementwise as ew
from .functions.expressions import evaluate as evaluate_text
from .operators import exact, grouping, indexing, linalg, reductions, scans
from .plans.positions import coordinate, number_rows, number_sorted
from .plans.windows import Layout, pos
from .schema import Group, Meta

UNSET = object()
_PLAIN = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "//": operator.floordiv, "%": operator.mod, "**": operator.pow, "<<": operator.lshift, ">>": operator.rshift, "&": operator.and_, "|": operator.or_, "^": operator.xor, "@": operator.matmul, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _value(x: object) -> object:
    return x.item() if isinstance(x, np.generic) else x


class Lattice:
    """Variables on dimensions. Nothing runs until a result is asked for, save where a size must be known."""

    __hash__ = None

    def __init__(self, groups: list[Group], meta: Meta, layout: Layout = Layout(), name: str | None = None):
        self._groups, self._meta, self._layout, self._name = groups, meta, layout, name

    # -- construction ---------------------------------------------------------

    @classmethod
    def from_frame(cls, df: DataFrame, dims: Iterable[str], variables: Iterable[str], *, layout: Layout = Layout(), check: bool = True, densify: bool = False, attrs: dict | None = None) -> Lattice:
        """An array from rows: one row per cell, dimension labels in `dims`.

        Labels become sorted coordinates. check: two rows for one cell are an
        error. densify: cells without a row are added as missing. NaN is missing.
        """
        dims, variables = tuple(dims), list(variables)
        df = df.select(*dims, *(ew.no_nan(F.col(v)).alias(v) if dict(df.dtypes)[v] in ("double", "float") else F.col(v) for v in variables))
        for d in dims:
            df = df.where(F.col(d).isNotNull())
        if check and df.groupBy(*dims).count().where("count > 1").limit(1).collect():
            raise ValueError(f"{dims} do not identify a cell: aggregate the rows first")
        sizes, out = {}, df
        if len(dims) == 1:
            sizes[dims[0]] = df.count()
            out = number_rows(df, dims[0], pos(dims[0]), sizes[dims[0]], layout.block)
        else:
            grid = None
            for d in dims:
                at, sizes[d] = coordinate(df, d, layout.block)
                if densify:
                    grid = at if grid is None else grid.crossJoin(at)
                else:
                    out = out.join(at, d)
            if densify:
                out = grid.join(out, list(dims), "left")
        out = out.select(*(c for d in dims for c in (pos(d), d)), *variables)
        return cls([Group.of(dims, out, variables)], Meta(sizes, frozenset(dims), dict(attrs or {})), layout, variables[0] if len(variables) == 1 else None)

    @classmethod
    def from_groups(cls, groups: list[Group], meta: Meta, layout: Layout = Layout(), name: str | None = None) -> Lattice:
        return cls(groups, meta, layout, name)

    def _new(self, groups: list[Group], sizes: dict[str, int] | None = None, *, labelled: Iterable[str] | None = None, name: object = UNSET) -> Lattice:
        merged: list[Group] = []
        for g in groups:
            for i, m in enumerate(merged):
                if m.dims == g.dims and m.df is g.df:
                    merged[i] = m.with_exprs(m.exprs | g.exprs, m.kinds | g.kinds)
                    break
            else:
                merged.append(g)
        used = {d for g in merged for d in g.dims}
        sizes = {k: v for k, v in (self._meta.sizes if sizes is None else sizes).items() if k in used}
        marks = frozenset(d for d in (self._meta.labelled if labelled is None else labelled) if d in used)
        names = {n for g in merged for n in g.exprs}
        meta = replace(self._meta, sizes=sizes, labelled=marks, var_attrs={k: v for k, v in self._meta.var_attrs.items() if k in names})
        return Lattice(merged, meta, self._layout, (self._name if self._name in names else None) if name is UNSET else name)

    def _per_group(self, dim: str, fn: Callable[[Group], Group], size: int | None = None) -> Lattice:
        """Apply fn to the groups that have dim; others pass through."""
        self._need(dim)
        sizes = self.sizes if size is None else self.sizes | {dim: size}
        return self._new([fn(g) if dim in g.dims else g for g in self._groups], sizes)

    def _need(self, dim: str) -> None:
        if not isinstance(dim, str):
            raise TypeError("a dimension is named by a str")
        if dim not in self.sizes:
            raise ValueError(f"no dimension {dim!r} among {tuple(self.sizes)}")

    # -- attributes -----------------------------------------------------------

    @property
    def sizes(self) -> dict[str, int]:
        return dict(self._meta.sizes)

    @property
    def dims(self) -> tuple[str, ...]:
        return self._groups[0].dims if self._name and len(self._groups) == 1 else tuple(self._meta.sizes)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self._meta.sizes[d] for d in self.dims)

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def variables(self) -> dict[str, tuple[str, ...]]:
        return {n: g.dims for g in self._groups for n in g.exprs}

    data_vars = variables

    @property
    def dtypes(self) -> dict[str, str]:
        return {n: t for g in self._groups for n, t in g.frame().dtypes if n in g.exprs}

    @property
    def dtype(self) -> str:
        return self.dtypes[self._one()]

    @property
    def attrs(self) -> dict:
        return dict(self._meta.attrs)

    @property
    def encoding(self) -> dict:
        return dict(self._meta.encoding)

    @property
    def name(self) -> str | None:
        return self._name

    @property
    def nbytes(self) -> int:
        width = {"double": 8, "bigint": 8, "timestamp_ntz": 8, "float": 4, "int": 4, "boolean": 1, "smallint": 2, "tinyint": 1}
        return sum(width.get(self.dtypes[n], 8) * math.prod(self.sizes[d] for d in dims) for n, dims in self.variables.items())

    @property
    def coords(self) -> dict[str, DataFrame]:
        return {d: self.coordinate(d) for d in self._meta.sizes if d in self._meta.labelled}

    indexes = coords

    @property
    def T(self) -> Lattice:  # noqa: N802
        return self.transpose()

    @property
    def values(self) -> np.ndarray:
        return self.to_numpy()

    def __bool__(self) -> bool:
        raise ValueError("the truth of a distributed array is not defined")

    def _one(self, what: str = "this") -> str:
        names = [n for g in self._groups for n in g.exprs]
        if len(names) != 1:
            raise ValueError(f"{what} takes a single variable; there are {names}")
        return names[0]

    def coordinate(self, dim: str) -> DataFrame:
        """(position, label) of a dimension."""
        self._need(dim)
        g = next(g for g in self._groups if dim in g.dims)
        return g.df.select(pos(dim), dim).distinct()

    def frame(self, name: str | None = None) -> DataFrame:
        """Rows of one group (that of `name`, else the only one): positions, labels and variables."""
        if name is None and len(self._groups) != 1:
            raise ValueError("variables lie on different dimensions; name one")
        return next(g for g in self._groups if name is None or name in g.exprs).frame()

    def to_table(self, name: str | None = None) -> DataFrame:
        """Rows without positions."""
        df = self.frame(name)
        return df.drop(*(c for c in df.columns if c.startswith("__pos_")))

    def to_numpy(self, name: str | None = None) -> np.ndarray:
        """A dense array on the driver; missing floats are NaN. Meant for small results."""
        name = name or self._one("to_numpy")
        g = next(g for g in self._groups if name in g.exprs)
        rows = g.frame().select(*(pos(d) for d in g.dims), name).toPandas()
        kind, shape = g.kinds[name], tuple(self.sizes[d] for d in g.dims)
        column = rows[name]
        if kind == "bool" and not column.isna().any():
            out = np.zeros(shape, bool)
        elif kind == "int" and not column.isna().any():
            out = np.zeros(shape, np.int64)
        elif kind == "other":
            out = np.empty(shape, object)
        else:
            out, column = np.full(shape, np.nan), column.astype(float)
        out[tuple(rows[pos(d)].to_numpy() for d in g.dims)] = column.to_numpy() if g.dims else column.iloc[0]
        return out

    def compute(self) -> Lattice:
        return self._materialised(lambda df: df.cache())

    load = persist = compute

    def chunk(self, n: int | None = None, dim: str | None = None) -> Lattice:
        return self.repartition(dim or "auto", n)

    def _materialised(self, fn: Callable[[DataFrame], DataFrame]) -> Lattice:
        return self._new([Group.of(g.dims, fn(g.frame()), list(g.exprs), g.kinds) for g in self._groups])

    def partition_dim(self) -> str:
        """The longest dimension, the first of equals."""
        return max(self._meta.sizes, key=lambda d: (self._meta.sizes[d] > 1, self._meta.sizes[d]))

    def repartition(self, dim: str = "auto", n: int | None = None) -> Lattice:
        """Contiguous slabs of one dimension."""
        d = self.partition_dim() if dim == "auto" else dim
        self._need(d)
        deal = lambda df: df.repartitionByRange(*([n] if n else []), pos(d))
        return self._new([Group.of(g.dims, deal(g.frame()), list(g.exprs), g.kinds) if d in g.dims else g for g in self._groups])

    def describe_partitions(self, name: str | None = None) -> DataFrame:
        """Rows and position bounds of each partition."""
        df = self.frame(name)
        at = [c for c in df.columns if c.startswith("__pos_")]
        return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("cells"), *(x for c in at for x in (F.min(c).alias(f"first_{c[6:]}"), F.max(c).alias(f"last_{c[6:]}"))))

    # -- schema edits ---------------------------------------------------------

    def __getitem__(self, key: str) -> Lattice:
        if not isinstance(key, str):
            raise TypeError("variables are chosen by name")
        for g in self._groups:
            if key in g.exprs:
                return self._new([g.with_exprs({key: g.exprs[key]}, {key: g.kinds[key]})], name=key)
        raise KeyError(key)

    def rename(self, names: dict[str, str]) -> Lattice:
        out = self.rename_vars({k: v for k, v in names.items() if k in self.variables})
        return out.rename_dims({k: v for k, v in names.items() if k in self.sizes})

    def rename_vars(self, names: dict[str, str]) -> Lattice:
        groups = [g.with_exprs({names.get(n, n): c for n, c in g.exprs.items()}, {names.get(n, n): k for n, k in g.kinds.items()}) for g in self._groups]
        return self._new(groups, name=names.get(self._name, self._name))

    def rename_dims(self, names: dict[str, str]) -> Lattice:
        if not names:
            return self
        groups = []
        for g in self._groups:
            df = g.frame().withColumnsRenamed({c: new for d in g.dims if d in names for c, new in ((pos(d), pos(names[d])), (d, names[d]))})
            groups.append(Group.of(tuple(names.get(d, d) for d in g.dims), df, list(g.exprs), g.kinds))
        return self._new(groups, {names.get(d, d): n for d, n in self.sizes.items()}, labelled={names.get(d, d) for d in self._meta.labelled})

    def transpose(self, *dims: str) -> Lattice:
        order = list(dims) or list(reversed(self._meta.sizes))
        if set(order) != set(self._meta.sizes):
            raise ValueError(f"dimensions are {tuple(self._meta.sizes)}")
        return self._new([replace(g, dims=tuple(d for d in order if d in g.dims)) for g in self._groups], {d: self.sizes[d] for d in order})

    def expand_dims(self, dim: str, label: object = None) -> Lattice:
        if dim in self.sizes:
            raise ValueError(f"{dim!r} exists")
        made = []
        for g in self._groups:
            df = g.frame().withColumns({pos(dim): F.lit(0).cast("long"), dim: F.lit(0).cast("long") if label is None else F.lit(label)})
            made.append(Group.of((dim, *g.dims), df, list(g.exprs), g.kinds))
        return self._new(made, {dim: 1} | self.sizes, labelled=self._meta.labelled | ({dim} if label is not None else set()))

    def drop_vars(self, names: str | Iterable[str]) -> Lattice:
        gone = {names} if isinstance(names, str) else set(names)
        if missing := gone - set(self.variables):
            raise ValueError(f"no variables {sorted(missing)}")
        left = [g.with_exprs({n: c for n, c in g.exprs.items() if n not in gone}, {n: k for n, k in g.kinds.items() if n not in gone}) for g in self._groups]
        return self._new([g for g in left if g.exprs])

    def assign_coords(self, **labels: object) -> Lattice:
        """New labels: a sequence of the dimension's length, or a function of the label column."""
        groups, out = self._groups, self
        for dim, new in labels.items():
            self._need(dim)
            made = []
            for g in groups:
                if dim not in g.dims:
                    made.append(g)
                elif callable(new):
                    made.append(Group.of(g.dims, g.frame().withColumn(dim, new(F.col(dim))), list(g.exprs), g.kinds))
                else:
                    values = [_value(v) for v in new]
                    if len(values) != self.sizes[dim]:
                        raise ValueError(f"{dim!r} has {self.sizes[dim]} labels, not {len(values)}")
                    table = g.df.sparkSession.createDataFrame(list(enumerate(values)), [pos(dim), dim])
                    made.append(Group.of(g.dims, g.frame().drop(dim).join(table, pos(dim)), list(g.exprs), g.kinds))
            groups = made
        return out._new(groups, labelled=self._meta.labelled | set(labels))

    def assign_attrs(self, **attrs: object) -> Lattice:
        out = self._new(self._groups)
        out._meta = replace(out._meta, attrs=self._meta.attrs | attrs)
        return out

    def set_coords(self, names: str | Iterable[str]) -> Lattice:
        out = self._new(self._groups)
        out._meta = replace(out._meta, coords=self._meta.coords | ({names} if isinstance(names, str) else set(names)))
        return out

    def reset_coords(self, names: str | Iterable[str] | None = None) -> Lattice:
        gone = self._meta.coords if names is None else {names} if isinstance(names, str) else set(names)
        out = self._new(self._groups)
        out._meta = replace(out._meta, coords=self._meta.coords - gone)
        return out

    # -- elementwise ----------------------------------------------------------

    def _map(self, fn: Callable[[Column, str], tuple[Column, str]]) -> Lattice:
        groups = []
        for g in self._groups:
            made = {n: fn(c, g.kinds[n]) for n, c in g.exprs.items()}
            groups.append(g.with_exprs({n: c for n, (c, _) in made.items()}, {n: k for n, (_, k) in made.items()}))
        return self._new(groups)

    def _aligned(self, other: Lattice) -> list[tuple[Group, list[tuple[str, Column, str, Column, str]]]]:
        """Pairs of same-named variables (or of single ones) brought into one DataFrame: (output name, a, kind, b, kind)."""
        mine = {n: g for g in self._groups for n in g.exprs}
        theirs = {n: g for g in other._groups for n in g.exprs}
        if len(theirs) == 1:
            pairs = [(n, n, next(iter(theirs))) for n in mine]
        elif len(mine) == 1:
            pairs = [(n, next(iter(mine)), n) for n in theirs]
        else:
            pairs = [(n, n, n) for n in mine if n in theirs]
        out = []
        for name, an, bn in pairs:
            a, b = mine[an], theirs[bn]
            if a.df is b.df and set(a.dims) == set(b.dims):
                out.append((a, [(name, a.exprs[an], a.kinds[an], b.exprs[bn], b.kinds[bn])]))
                continue
            shared = [d for d in a.dims if d in b.dims]
            for d in shared:
                if self.sizes[d] != other.sizes[d]:
                    raise ValueError(f"sizes along {d!r} differ: {self.sizes[d]} and {other.sizes[d]}")
                self._check_labels(other, d)
            x = a.frame().withColumnRenamed(an, "__a").select(*a.keys(), "__a")
            y = b.frame().withColumnRenamed(bn, "__b").select(*(c for d in b.dims if d not in shared for c in (pos(d), d)), *(pos(d) for d in shared), "__b")
            joined = x.join(y, [pos(d) for d in shared]) if shared else x.crossJoin(y)
            dims = (*a.dims, *(d for d in b.dims if d not in shared))
            out.append((Group(dims, joined, {}, {}), [(name, F.col("__a"), a.kinds[an], F.col("__b"), b.kinds[bn])]))
        return out

    def _check_labels(self, other: Lattice, dim: str) -> None:
        if dim not in self._meta.labelled or dim not in other._meta.labelled:
            return
        a, b = self.coordinate(dim), other.coordinate(dim)
        if a.join(b.withColumnRenamed(dim, "__o"), pos(dim)).where(~F.col(dim).eqNullSafe(F.col("__o"))).limit(1).collect():
            raise ValueError(f"labels along {dim!r} differ")

    def _binary(self, op: str, other: object, swapped: bool = False, fn: Callable | None = None) -> Lattice:
        if op == "@":
            return other.matmul(self) if swapped else self.matmul(other)
        do = fn or (lambda a, b, ka, kb: ew.binary(op, a, b, ka, kb))
        turn = lambda a, b, ka, kb: do(b, a, kb, ka) if swapped else do(a, b, ka, kb)
        other = _value(other)
        if not isinstance(other, Lattice):
            if isinstance(other, np.ndarray) and other.ndim:
                return self._binary(op, self._beside(other), swapped, fn)
            other = _value(other[()]) if isinstance(other, np.ndarray) else other
            c, k = ew.as_column(other), "float" if isinstance(other, Column) else ew.kind_of_value(other)
            return self._map(lambda a, ka: turn(a, c, ka, k))
        groups, sizes = [], self.sizes | other.sizes
        for g, cells in self._aligned(other):
            made = {name: turn(a, b, ka, kb) for name, a, ka, b, kb in cells}
            groups.append(Group(g.dims, g.df, {n: c for n, (c, _) in made.items()}, {n: k for n, (_, k) in made.items()}))
        return self._new(groups, sizes, labelled=self._meta.labelled | other._meta.labelled)

    def _beside(self, values: np.ndarray) -> Lattice:
        """A raw array as one on this array's last dimensions; a length of one stands for all cells of a dimension."""
        from .sources.build import from_numpy

        dims = self.dims[len(self.dims) - values.ndim :] if values.ndim <= len(self.dims) else ()
        if len(dims) != values.ndim or any(n not in (1, self.sizes[d]) for d, n in zip(dims, values.shape, strict=True)):
            raise ValueError(f"a raw array of shape {values.shape} doesn't fit {dict((d, self.sizes[d]) for d in self.dims)}")
        whole = [d for d, n in zip(dims, values.shape, strict=True) if n == self.sizes[d]]
        shape = tuple(self.sizes[d] for d in whole)
        return from_numpy(self._groups[0].df.sparkSession, values.reshape(shape), whole, name="__raw")

    def __array_ufunc__(self, ufunc: np.ufunc, method: str, *inputs: object, **kwargs: object) -> Lattice:
        if method != "__call__" or kwargs.get("out") is not None:
            return NotImplemented
        return apply_named(ufunc.__name__, *inputs)

    def isnull(self) -> Lattice:
        return self._map(lambda c, k: (c.isNull(), "bool"))

    def notnull(self) -> Lattice:
        return self._map(lambda c, k: (c.isNotNull(), "bool"))

    def fillna(self, value: object) -> Lattice:
        if isinstance(value, Lattice):
            return self._binary("fill", value, fn=lambda a, b, ka, kb: (F.coalesce(a, b), ew.both(ka, kb)))
        return self._map(lambda c, k: (F.coalesce(c, F.lit(value)), k))

    def clip(self, min: object = None, max: object = None) -> Lattice:  # noqa: A002
        return self._map(lambda c, k: (ew.clip(c, min, max), k))

    def round(self, digits: int = 0) -> Lattice:
        return self._map(lambda c, k: (ew.rounded(c, digits), k))

    def astype(self, kind: str) -> Lattice:
        """double, float, int, bigint, boolean, ...: Spark's type names."""
        out = {"double": "float", "float": "float", "boolean": "bool", "string": "other"}.get(kind, "int")
        return self._map(lambda c, k: (c.cast(kind), out))

    def where(self, cond: Lattice, other: object = UNSET, *, drop: bool = False) -> Lattice:
        """Values where cond holds (a missing cond doesn't), elsewhere `other` (missing by default). drop: cut away labels at which cond never holds."""
        other = None if other is UNSET else _value(other)
        if isinstance(other, Lattice):
            kept = self._binary("where", cond, fn=lambda a, b, ka, kb: (F.when(F.coalesce(b, F.lit(False)), F.struct(a.alias("v"))), "other"))
            names = {n: g.kinds[n] for g in self._groups for n in g.exprs}
            out = kept._binary("else", other, fn=lambda a, b, ka, kb: (F.when(a.isNotNull(), a["v"]).otherwise(b), kb))
            return out._new([g.with_exprs(g.exprs, {n: ew.both(names.get(n, k), k) for n, k in g.kinds.items()}) for g in out._groups])

        def pick(a: Column, b: Column, ka: str, kb: str) -> tuple[Column, str]:
            wide = a.cast("double") if ka == "int" and (other is None or isinstance(other, float)) else a
            chosen = F.when(F.coalesce(b, F.lit(False)), wide)
            return (chosen if other is None else chosen.otherwise(ew.as_column(other))), "float" if ka == "int" and (other is None or isinstance(other, float)) else ka

        out = self._binary("where", cond, fn=pick)
        if not drop:
            return out
        for d in cond.sizes:
            held = cond._groups[0].frame().where(F.col(cond._one())).select(F.col(pos(d)).alias("old"), F.col(d).alias("label")).distinct()
            n = held.count()
            mapping = indexing.sort_mapping(held, [], True, n, self._layout.block)
            out = out._per_group(d, lambda g, d=d, mapping=mapping: indexing.take_map(g, d, mapping, None, False), n)
        return out

    def apply(self, func: Callable, *args: object, **kwargs: object) -> Lattice:
        """func of this array's columns and those of all arrays among args, returning a Column.

        It may be built of Spark's functions or be a pandas_udf. Dimensions stay.
        """
        spots = [i for i, a in enumerate(args) if isinstance(a, Lattice)]
        if spots:
            # all arrays in one row per cell, then one expression over them
            joined = self._map(lambda c, k: (F.struct(c.alias("own")), "other"))
            for i in spots:
                joined = joined._binary("apply", args[i], fn=lambda a, b, ka, kb, i=i: (a.withField(f"a{i}", b), "other"))
            fields = lambda c: [c[f"a{i}"] if i in spots else a for i, a in enumerate(args)]
            return joined.apply(lambda c: func(c["own"], *fields(c), **kwargs))
        groups = []
        for g in self._groups:
            made = {n: func(c, *args, **kwargs) for n, c in g.exprs.items()}
            types = {f.name: f.dataType for f in g.df.select(*(c.alias(n) for n, c in made.items())).schema.fields}
            groups.append(g.with_exprs(made, {n: ew.kind_of(types[n]) for n in made}))
        return self._new(groups)

    def evaluate(self, expression: str, /, **variables: object) -> object:
        """A Python expression over this object's variables and the given ones."""
        names = {n: self[n] for n in self.variables} | variables
        arr = lambda x: isinstance(x, Lattice)

        def two(op: str, a: object, b: object) -> object:
            if arr(a):
                return a._binary(op, b)
            return b._binary(op, a, swapped=True) if arr(b) else _PLAIN[op](a, b)

        one = lambda op, a: a._map(lambda c, k: ew.unary(op, c, k)) if arr(a) else {"-": operator.neg, "+": operator.pos, "~": operator.invert}[op](a)
        return evaluate_text(expression, names, two, one, arr)

    # -- reductions -----------------------------------------------------------

    def _over(self, dim: object) -> set[str]:
        if dim is None or dim is ...:
            return set(self._meta.sizes)
        dims = [dim] if isinstance(dim, str) else list(dim)
        for d in dims:
            self._need(d)
        return set(dims)

    def _reduce(self, op: str, dim: object, **how: object) -> Lattice:
        over = self._over(dim)
        return self._new([reductions.reduce_group(g, over & set(g.dims), op, **how) if over & set(g.dims) else g for g in self._groups])

    def sum(self, dim=None, *, skipna=None, min_count=None, **_) -> Lattice:
        return self._reduce("sum", dim, skipna=skipna, min_count=min_count)

    def prod(self, dim=None, *, skipna=None, min_count=None, **_) -> Lattice:
        return self._reduce("prod", dim, skipna=skipna, min_count=min_count)

    def mean(self, dim=None, *, skipna=None, **_) -> Lattice:
        return self._reduce("mean", dim, skipna=skipna)

    def min(self, dim=None, *, skipna=None, **_) -> Lattice:
        return self._reduce("min", dim, skipna=skipna)

    def max(self, dim=None, *, skipna=None, **_) -> Lattice:
        return self._reduce("max", dim, skipna=skipna)

    def any(self, dim=None, **_) -> Lattice:
        return self._reduce("any", dim)

    def all(self, dim=None, **_) -> Lattice:
        return self._reduce("all", dim)

    def count(self, dim=None, **_) -> Lattice:
        return self._reduce("count", dim)

    def var(self, dim=None, *, skipna=None, ddof: int = 0, **_) -> Lattice:
        return self._reduce("var", dim, skipna=skipna, ddof=ddof)

    def std(self, dim=None, *, skipna=None, ddof: int = 0, **_) -> Lattice:
        return self._reduce("std", dim, skipna=skipna, ddof=ddof)

    def _edge(self, op: str, dim: str, skipna: bool | None) -> Lattice:
        if not isinstance(dim, str):
            raise TypeError(f"{op} takes one dimension by name")
        self._need(dim)
        return self._reduce(op, dim, skipna=skipna)

    def first(self, dim: str, *, skipna=None, **_) -> Lattice:
        return self._edge("first", dim, skipna)

    def last(self, dim: str, *, skipna=None, **_) -> Lattice:
        return self._edge("last", dim, skipna)

    def median(self, dim: str, *, skipna=None, **_) -> Lattice:
        return self._reduce("median", dim, skipna=skipna)

    def quantile(self, q, dim: str, *, method: str = "linear", skipna=None, **_) -> Lattice:
        self._need(dim)
        groups, sizes = [], self.sizes
        for g in self._groups:
            made, n = reductions.quantile_group(g, dim, q, method, skipna) if dim in g.dims else (g, None)
            groups.append(made)
            sizes |= {"quantile": n} if n else {}
        return self._new(groups, sizes, labelled=self._meta.labelled | {"quantile"})

    def exact_sum(self, dim=None) -> Lattice:
        """A sum that is the same to the last bit however rows are partitioned."""
        return self._exact(dim, lambda g, keys, n: exact.exact_sum(g.frame(), n, keys, n))

    def exact_prod(self, dim=None) -> Lattice:
        return self._exact(dim, lambda g, keys, n: exact.exact_product(g.frame().where(F.col(n).isNotNull()), n, keys, n, g.kinds[n] != "float"))

    def _exact(self, dim, fn) -> Lattice:
        over, name = self._over(dim), self._one("an exact reduction")
        g = self._groups[0]
        keys = g.keys(*over)
        return self._new([Group.of(tuple(d for d in g.dims if d not in over), fn(g, keys, name), [name])])

    def checksum(self, mask_value: float | None = None) -> int:
        name = self._one("checksum")
        return exact.checksum(self.frame(), name, None, mask_value).first()[0]

    def same_field(self, other: Lattice) -> bool:
        """Whether two arrays hold the same bits, by checksums of values and of values tied to their places."""

        def tied(x: Lattice) -> DataFrame:
            g = x._groups[0]
            return x.frame().select(F.xxhash64(*(pos(d) for d in sorted(g.dims)), exact.raw_bits(F.col(x._one()))).alias("h"))

        return self.sizes == other.sizes and exact.checksum(tied(self), "h").first()[0] == exact.checksum(tied(other), "h").first()[0]

    # -- grouping -------------------------------------------------------------

    def groupby(self, dim: str, labels: object, name: str = "group") -> Grouped:
        """labels: a function of the label column, a sequence per position, or a variable of this object along dim."""
        self._need(dim)
        return Grouped(self, dim, labels, name)

    def resample(self, dim: str, freq: str, *, fill_gaps: bool = False) -> Resampled:
        self._need(dim)
        grouping.parse_frequency(freq)
        return Resampled(self, dim, freq, fill_gaps)

    def weighted(self, weights: Lattice) -> Weighted:
        return Weighted(self, weights)

    # -- windows, scans and stencils ------------------------------------------

    def rolling(self, dim: str, window: int, *, center: bool = True, min_periods: int | None = None) -> Rolling:
        self._need(dim)
        return Rolling(self, dim, window, center, min_periods)

    def rolling_reduce(self, dim: str, window: int, reduce: str = "mean", *, center: bool = True, min_periods: int | None = None) -> Lattice:
        return self._per_group(dim, lambda g: scans.rolling(g, dim, window, reduce, center, min_periods, self.sizes, self._layout))

    def coarsen_reduce(self, dim: str, window: int, reduce: str = "mean", *, boundary: str = "exact", side: str = "left", coord_func: str = "mean") -> Lattice:
        self._need(dim)
        n = self.sizes[dim]
        size = -(-n // window) if boundary == "pad" else n // window
        return self._per_group(dim, lambda g: scans.coarsen(g, dim, window, reduce, boundary, side, coord_func, n)[0], size)

    def cumsum(self, dim: str, *, skipna=None, **_) -> Lattice:
        return self._per_group(dim, lambda g: scans.cumulative(g, dim, "cumsum", skipna, self.sizes, self._layout))

    def cumprod(self, dim: str, *, skipna=None, **_) -> Lattice:
        return self._per_group(dim, lambda g: scans.cumulative(g, dim, "cumprod", skipna, self.sizes, self._layout))

    def diff(self, dim: str, n: int = 1, *, label: str = "upper") -> Lattice:
        if n < 0 or label not in ("upper", "lower"):
            raise ValueError("n must not be negative and label is upper or lower")
        self._need(dim)
        if n == 0:
            return self
        return self._per_group(dim, lambda g: scans.diff(g, dim, n, label, self.sizes, self._layout), max(0, self.sizes[dim] - n))

    def shift(self, dim: str, periods: int = 1, *, fill_value: object = UNSET) -> Lattice:
        value = None if fill_value is UNSET else _value(fill_value)
        return self._per_group(dim, lambda g: scans.shift(g, dim, periods, value, self.sizes, self._layout))

    def roll(self, dim: str, shift_by: int) -> Lattice:
        return self._per_group(dim, lambda g: scans.roll(g, dim, shift_by, self.sizes))

    def pad(self, dim: str, pad_width: int | tuple[int, int], *, mode: str = "constant", constant_values: object = None) -> Lattice:
        if mode != "constant":
            raise NotImplementedError("pad() has the constant mode")
        before, after = (pad_width, pad_width) if isinstance(pad_width, int) else pad_width
        self._need(dim)
        return self._per_group(dim, lambda g: scans.pad(g, dim, before, after, _value(constant_values), self.sizes), self.sizes[dim] + before + after)

    def ffill(self, dim: str, limit: int | None = None) -> Lattice:
        return self._per_group(dim, lambda g: scans.fill(g, dim, limit, True, self.sizes, self._layout))

    def bfill(self, dim: str, limit: int | None = None) -> Lattice:
        return self._per_group(dim, lambda g: scans.fill(g, dim, limit, False, self.sizes, self._layout))

    def interp(self, dim: str, new_coord: object, method: str = "linear") -> Lattice:
        self._need(dim)
        table, n = self._labels_table(dim, new_coord)
        targets = table.select(F.col("new").alias(pos(dim)), F.col("label").alias(dim))
        return self._per_group(dim, lambda g: scans.interp(g, dim, targets, n, method, self.sizes, self._layout), n)

    def differentiate(self, coord: str, edge_order: int = 1, datetime_unit: str | None = None, nan: bool = False) -> Lattice:
        """nan: where repeated labels leave 0 / 0, NaN in place of a missing value."""
        return self._per_group(coord, lambda g: scans.differentiate(g, coord, edge_order, datetime_unit, nan, self.sizes, self._layout))

    # -- indexing -------------------------------------------------------------

    def _labels_table(self, dim: str, labels: object) -> tuple[DataFrame, int]:
        """(new, label) from a sequence, or from a DataFrame whose only column holds labels in ascending order."""
        g = next(g for g in self._groups if dim in g.dims)
        kind = dict(g.df.dtypes)[dim]
        if isinstance(labels, DataFrame):
            n = labels.count()
            (column,) = labels.columns
            return number_rows(labels.select(F.col(column).cast(kind).alias("label")), "label", "new", n, self._layout.block), n
        values = [_value(v) for v in labels]
        if any(isinstance(v, (list, tuple, np.ndarray)) for v in values):
            raise ValueError("labels are one-dimensional")
        given = "double" if values and all(isinstance(v, float) for v in values) else "long" if values and all(isinstance(v, int) for v in values) else "timestamp_ntz" if values and isinstance(values[0], dt.datetime) else "string" if values and isinstance(values[0], str) else kind
        table = g.df.sparkSession.createDataFrame(list(enumerate(values)), f"new long, label {given}")
        return (table if given == kind or kind in ("bigint", "int") and given == "double" else table.withColumn("label", F.col("label").cast(kind))), len(values)

    def isel(self, indexers: dict | None = None, **more: object) -> Lattice:
        out = self
        for dim, index in ((indexers or {}) | more).items():
            out = out._isel(dim, _value(index))
        return out

    def _isel(self, dim: str, index: object) -> Lattice:
        self._need(dim)
        n = self.sizes[dim]
        if isinstance(index, slice):
            picked = range(*index.indices(n))
            if not picked:
                return self._per_group(dim, lambda g: indexing.take_slice(g, dim, 0, 0), 0)
            if picked.step < 0:
                return self._per_group(dim, lambda g: indexing.take_reversed(g, dim, picked), len(picked))
            return self._per_group(dim, lambda g: indexing.take_slice(g, dim, picked.start, picked.stop, picked.step), len(picked))
        if isinstance(index, int):
            if not -n <= index < n:
                raise IndexError(f"{index} is outside {dim!r}, which has {n} cells")
            return self._per_group(dim, lambda g: indexing.take_one(g, dim, index % n))
        spots = [int(i) for i in index]
        if any(not -n <= i < n for i in spots):
            raise IndexError(f"an index is outside {dim!r}, which has {n} cells")
        g0 = next(g for g in self._groups if dim in g.dims)
        table = g0.df.sparkSession.createDataFrame([(k, i % n) for k, i in enumerate(spots)], f"new long, `{pos(dim)}` long")
        mapping = F.broadcast(table).join(self.coordinate(dim), pos(dim)).select("new", F.col(dim).alias("label"), F.col(pos(dim)).alias("old"))
        return self._per_group(dim, lambda g: indexing.take_map(g, dim, mapping, None, False), len(spots))

    def sel(self, indexers: dict | None = None, method: str | None = None, tolerance: object = None, drop: bool = False, **more: object) -> Lattice:
        out = self
        for dim, index in ((indexers or {}) | more).items():
            out = out._sel(dim, _value(index), method, tolerance)
        # a label that a scalar selects isn't kept, so there is none to drop
        return out

    def _sel(self, dim: str, index: object, method: str | None, tolerance: object) -> Lattice:
        self._need(dim)
        coord = self.coordinate(dim)
        if isinstance(index, slice):
            if method is not None:
                raise NotImplementedError("a slice of labels takes no method")
            c, inside = F.col(dim), F.lit(True)
            if index.start is not None:
                inside = inside & (c >= ew.as_column(_value(index.start)))
            if index.stop is not None:
                inside = inside & (c <= ew.as_column(_value(index.stop)))
            ends = coord.where(inside).agg(F.min(pos(dim)).alias("a"), F.max(pos(dim)).alias("b")).first()
            if ends["a"] is None:
                return self._isel(dim, slice(0, 0))
            # the labels' own filter reaches the scan; positions only renumber what is left
            near = self._per_group(dim, lambda g: Group(g.dims, g.frame().where(inside), {n: F.col(n) for n in g.exprs}, g.kinds))
            return near._isel(dim, slice(ends["a"], ends["b"] + 1, index.step))
        scalar = isinstance(index, str) or not hasattr(index, "__iter__")
        wanted, n = self._labels_table(dim, [index] if scalar else index)
        told = indexing.match_labels(coord.select(F.col(dim).alias("label"), F.col(pos(dim)).alias("old")), wanted, method, tolerance, self.sizes[dim] + n, self._layout.block).orderBy("new", "old").collect()
        if any(r["old"] is None for r in told):
            raise KeyError(f"no label for {[r['label'] for r in told if r['old'] is None]} along {dim!r}")
        if len(told) > n:
            raise NotImplementedError(f"labels along {dim!r} are not unique")
        return self._isel(dim, told[0]["old"] if scalar else [r["old"] for r in told])

    def reindex(self, indexers: dict | None = None, *, method: str | None = None, tolerance: object = None, fill_value: object = UNSET, **more: object) -> Lattice:
        wanted = (indexers or {}) | more
        if not wanted:
            raise ValueError("reindex() needs labels")
        out, fill = self, None if fill_value is UNSET else _value(fill_value)
        for dim, labels in wanted.items():
            out._need(dim)
            table, n = out._labels_table(dim, labels)
            coord = out.coordinate(dim).select(F.col(dim).alias("label"), F.col(pos(dim)).alias("old"))
            mapping = indexing.match_labels(coord, table, method, tolerance, out.sizes[dim] + n, out._layout.block)
            out = out._per_group(dim, lambda g, dim=dim, mapping=mapping: indexing.take_map(g, dim, mapping, fill, True), n)
        return out

    def sortby(self, by: object, *, ascending: bool = True) -> Lattice:
        """Sort along one dimension by its labels, by one-dimensional variables, or by several keys, the first first."""
        keys = list(by) if isinstance(by, (list, tuple)) else [by]
        arrays = {f"__k{i}": self[k] if isinstance(k, str) and k in self.variables else k for i, k in enumerate(keys)}
        dims = {k if isinstance(k, str) else k.dims[0] for k in arrays.values()}
        if len(dims) != 1 or any(isinstance(k, Lattice) and len(k.dims) != 1 for k in arrays.values()):
            raise ValueError("all keys are one-dimensional and along one dimension")
        (dim,) = dims
        self._need(dim)
        keyed = self.coordinate(dim).select(F.col(pos(dim)).alias("old"), F.col(dim).alias("label"))
        for name, k in arrays.items():
            if isinstance(k, str):
                keyed = keyed.withColumn(name, F.col("label"))
            else:
                keyed = keyed.join(k.frame().select(F.col(pos(dim)).alias("old"), F.col(k._one()).alias(name)), "old")
        mapping = indexing.sort_mapping(keyed, list(arrays), ascending, self.sizes[dim], self._layout.block)
        return self._per_group(dim, lambda g: indexing.take_map(g, dim, mapping, None, False))

    def align(self, other: Lattice, dim: str | None = None) -> tuple[Lattice, Lattice]:
        """Both arrays, after checking that sizes and labels of shared dimensions (or of dim) are equal."""
        for d in [dim] if dim else [d for d in self.sizes if d in other.sizes]:
            if self.sizes.get(d) != other.sizes.get(d):
                raise ValueError(f"sizes along {d!r} differ")
            self._check_labels(other, d)
        return self, other

    def matmul(self, right: Lattice) -> Lattice:
        a, b = self._one("matmul"), right._one("matmul")
        for d in self.sizes:
            if d in right.sizes and self.sizes[d] != right.sizes[d]:
                raise ValueError(f"sizes along {d!r} differ")
        made = linalg.contract(self._groups[0], a, right._groups[0], b, a)
        return self._new([made], self.sizes | right.sizes, labelled=self._meta.labelled | right._meta.labelled)

    def largest(self, dim: str, by: Lattice | str, k: int, *, ascending: bool = False) -> Lattice:
        """The k cells of dim with the largest (smallest, if ascending) values of a one-dimensional key, in that order, without sorting the rest."""
        key = self[by] if isinstance(by, str) and by in self.variables else by
        keyed = self.coordinate(dim).select(F.col(pos(dim)).alias("old"), F.col(dim).alias("label"))
        if isinstance(key, str):
            keyed = keyed.withColumn("__k0", F.col("label"))
        else:
            keyed = keyed.join(key.frame().select(F.col(pos(dim)).alias("old"), F.col(key._one()).alias("__k0")), "old")
        order = [F.asc_nulls_last("__k0"), F.asc("old")] if ascending else [F.desc_nulls_first("__k0"), F.desc("old")]
        n = min(k, self.sizes[dim])
        mapping = F.broadcast(number_sorted(keyed.orderBy(*order).limit(n), order, "new", n, max(n, 1)).select("new", "label", "old"))
        return self._per_group(dim, lambda g: indexing.take_map(g, dim, mapping, None, False), n)

    def halo(self, dim: str | Iterable[str], before: int | Iterable[int], after: int | Iterable[int], *, blocks: int | Iterable[int], cyclic: bool | Iterable[bool] = False) -> DataFrame:
        """Rows per block with those of neighbouring blocks within reach: column `block`, and `halo` for copies.

        With several dimensions, corners included, `block` and `at` are structs
        by dimension.
        """
        from .plans.halos import with_halo, with_halos

        if isinstance(dim, str):
            self._need(dim)
            return with_halo(self.frame(), dim, self.sizes[dim], blocks, before, after, cyclic)
        dims = list(dim)
        for d in dims:
            self._need(d)
        each = lambda x: list(x) if isinstance(x, (list, tuple)) else [x] * len(dims)
        return with_halos(self.frame(), [(d, self.sizes[d], *rest) for d, *rest in zip(dims, each(blocks), each(before), each(after), each(cyclic), strict=True)])

    def to_store(self, path: str, **how: object) -> None:
        from .sources.store import write

        write(self, path, **how)

    def to_netcdf(self, path: str, **how: object) -> None:
        from .sources.netcdf import write

        write(self, path, **how)


def _operators() -> None:
    for name, op in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "floordiv": "//", "mod": "%", "pow": "**", "and": "&", "or": "|", "xor": "^", "lshift": "<<", "rshift": ">>", "matmul": "@"}.items():
        setattr(Lattice, f"__{name}__", lambda self, other, op=op: self._binary(op, other))
        setattr(Lattice, f"__r{name}__", lambda self, other, op=op: self._binary(op, other, swapped=True))
    for name, op in {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "==", "ne": "!="}.items():
        setattr(Lattice, f"__{name}__", lambda self, other, op=op: self._binary(op, other))
    for name, op in {"neg": "-", "pos": "+", "abs": "abs", "invert": "~"}.items():
        setattr(Lattice, f"__{name}__", lambda self, op=op: self._map(lambda c, k: ew.unary(op, c, k)))


_operators()


def apply_named(name: str, *args: object) -> Lattice:
    """An elementwise function by its array name; at least one argument is an array."""
    if len(args) == 1:
        return args[0]._map(lambda c, k: ew.call(name, [c], [k]))
    a, b = args
    do = lambda x, y, kx, ky: ew.call(name, [x, y], [kx, ky])
    return a._binary(name, b, fn=do) if isinstance(a, Lattice) else b._binary(name, a, swapped=True, fn=do)


class Rolling:
    def __init__(self, parent: Lattice, dim: str, window: int, center: bool, min_periods: int | None):
        self._run = lambda op: parent.rolling_reduce(dim, window, op, center=center, min_periods=min_periods)

    def reduce(self, name: str) -> Lattice:
        """Any named reduction, own ones included."""
        return self._run(name)

    def mean(self) -> Lattice:
        return self._run("mean")

    def sum(self) -> Lattice:
        return self._run("sum")

    def min(self) -> Lattice:
        return self._run("min")

    def max(self) -> Lattice:
        return self._run("max")

    def std(self) -> Lattice:
        return self._run("std")

    def count(self) -> Lattice:
        return self._run("count")


class _GroupOps:
    def _run(self, op: str, skipna: bool | None) -> Lattice:
        raise NotImplementedError

    def sum(self, *, skipna=None, **_) -> Lattice:
        return self._run("sum", skipna)

    def mean(self, *, skipna=None, **_) -> Lattice:
        return self._run("mean", skipna)

    def count(self, *, skipna=None, **_) -> Lattice:
        return self._run("count", skipna)

    def min(self, *, skipna=None, **_) -> Lattice:
        return self._run("min", skipna)

    def max(self, *, skipna=None, **_) -> Lattice:
        return self._run("max", skipna)


class Grouped(_GroupOps):
    """Reductions within equal labels; the grouped dimension becomes `name`, with the sorted distinct labels."""

    def __init__(self, parent: Lattice, dim: str, labels: object, name: str):
        self._parent, self._dim, self._labels, self._name = parent, dim, labels, name

    def _run(self, op: str, skipna: bool | None) -> Lattice:
        parent, dim, labels, groups, size = self._parent, self._dim, self._labels, [], 0
        for g in parent._groups:
            if dim not in g.dims:
                groups.append(g)
                continue
            if callable(labels):
                label = labels(F.col(dim))
            else:
                if isinstance(labels, Lattice):
                    table = labels.frame().select(pos(dim), F.col(labels._one()).alias("__g"))
                else:
                    values = [_value(v) for v in labels]
                    if len(values) != parent.sizes[dim]:
                        raise ValueError(f"{len(values)} labels for {parent.sizes[dim]} cells along {dim!r}")
                    table = g.df.sparkSession.createDataFrame(list(enumerate(values)), [pos(dim), "__g"])
                label, joined = F.col("__g"), g.frame().join(table, pos(dim), "left")
                keyed = joined.withColumn(dim, label)
                made, size = grouping.group_by(Group.of(g.dims, keyed, list(g.exprs), g.kinds), dim, F.col(dim), op, self._name, skipna, parent._layout.block)
                groups.append(made)
                continue
            made, size = grouping.group_by(g, dim, label, op, self._name, skipna, parent._layout.block)
            groups.append(made)
        sizes = {self._name if d == dim else d: size if d == dim else n for d, n in parent.sizes.items()}
        return parent._new(groups, sizes, labelled=parent._meta.labelled | {self._name})


class Resampled(_GroupOps):
    """Reductions within bins of time; bins without rows are left out unless gaps are filled."""

    def __init__(self, parent: Lattice, dim: str, freq: str, gaps: bool):
        self._parent, self._dim, self._freq, self._gaps = parent, dim, freq, gaps

    def _run(self, op: str, skipna: bool | None) -> Lattice:
        parent, dim, groups, size = self._parent, self._dim, [], 0
        first = parent.coordinate(dim).agg(F.min(dim)).first()[0]
        if first is None:
            raise ValueError("there are no timestamps")
        for g in parent._groups:
            if dim not in g.dims:
                groups.append(g)
                continue
            made, size = grouping.group_by(g, dim, grouping.time_bins(F.col(dim), self._freq, first), op, dim, skipna, parent._layout.block)
            if self._gaps:
                made, size = grouping.fill_gaps(made, dim, self._freq, set(made.exprs) if op in ("count", "sum") else set())
            groups.append(made)
        return parent._new(groups, parent.sizes | {dim: size})


class Weighted:
    """Reductions with weights, which may lack dimensions of the parent."""

    def __init__(self, parent: Lattice, weights: Lattice):
        self._parent, self._weights = parent, weights

    def _run(self, op: str, dim: object, skipna: bool | None) -> Lattice:
        parent, w = self._parent, self._weights
        over, groups = parent._over(dim), []
        wg, wn = w._groups[0], w._one("weighted")
        for g in parent._groups:
            if not over & set(g.dims):
                groups.append(g)
                continue
            shared = [d for d in g.dims if d in wg.dims]
            if set(wg.dims) - set(shared):
                raise ValueError("weights have a dimension that the array lacks")
            for d in shared:
                if parent.sizes[d] != w.sizes[d]:
                    raise ValueError(f"sizes along {d!r} differ")
                parent._check_labels(w, d)
            side = wg.frame().select(*(pos(d) for d in shared), F.col(wn).alias("__w"))
            frame = g.frame().join(side, [pos(d) for d in shared]) if shared else g.frame().crossJoin(side)
            groups.append(grouping.weighted(g, over & set(g.dims), F.col("__w"), op, skipna, frame))
        return parent._new(groups)

    def sum_of_weights(self, dim=None, **_) -> Lattice:
        return self._run("sum_of_weights", dim, None)

    def sum(self, dim=None, *, skipna=None, **_) -> Lattice:
        return self._run("sum", dim, skipna)

    def mean(self, dim=None, *, skipna=None, **_) -> Lattice:
        return self._run("mean", dim, skipna)
