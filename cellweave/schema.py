"""Driver-side description of labelled arrays."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.elementwise import Kind, kind_of
from .plans.windows import pos


@dataclass(frozen=True)
class Group:
    """Variables on the same dimensions: a DataFrame with a position and a label column per dimension, and one expression per variable."""

    dims: tuple[str, ...]
    df: DataFrame
    exprs: dict[str, Column]
    kinds: dict[str, Kind]

    def keys(self, *without: str) -> list[str]:
        return [c for d in self.dims if d not in without for c in (pos(d), d)]

    def frame(self) -> DataFrame:
        return self.df.select(*self.keys(), *(c.alias(n) for n, c in self.exprs.items()))

    def with_exprs(self, exprs: dict[str, Column], kinds: dict[str, Kind]) -> Group:
        return replace(self, exprs=exprs, kinds=kinds)

    @staticmethod
    def of(dims: tuple[str, ...], df: DataFrame, names: list[str], kinds: dict[str, Kind] | None = None) -> Group:
        types = {f.name: f.dataType for f in df.schema.fields}
        return Group(dims, df, {n: F.col(n) for n in names}, {n: (kinds or {}).get(n) or kind_of(types[n]) for n in names})


@dataclass(frozen=True)
class Meta:
    """What belongs to the whole: sizes, dimensions with labels of their own, attributes."""

    sizes: dict[str, int]
    labelled: frozenset[str] = frozenset()
    attrs: dict[str, object] = field(default_factory=dict)
    var_attrs: dict[str, dict[str, object]] = field(default_factory=dict)
    encoding: dict[str, dict[str, object]] = field(default_factory=dict)
    coords: frozenset[str] = frozenset()  # variables that are auxiliary coordinates
