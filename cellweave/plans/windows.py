"""Windows along one dimension, plain or in blocks.

A window partitioned by the other dimensions is the plain form. Where these give
too few partitions for a long dimension, the dimension is cut into blocks: a
stencil gets halo rows copied into neighbouring blocks, a scan gets the totals
of all blocks before its own. No form puts a long dimension into one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "__blk"


@dataclass(frozen=True)
class Layout:
    """When to cut a dimension: blocks of `block` rows where other dims give fewer than `groups` partitions."""

    block: int = 262_144
    groups: int = 64


def pos(dim: str) -> str:
    return f"__pos_{dim}"


def needs_blocks(sizes: dict[str, int], dims: tuple[str, ...], dim: str, layout: Layout) -> bool:
    return sizes[dim] > layout.block and math.prod(sizes[d] for d in dims if d != dim) < layout.groups


def along(dims: tuple[str, ...], dim: str, *more: str) -> WindowSpec:
    return Window.partitionBy(*more, *(pos(d) for d in dims if d != dim)).orderBy(pos(dim))


def stencil(df: DataFrame, dims: tuple[str, ...], dim: str, sizes: dict[str, int], before: int, after: int, make: Callable[[WindowSpec], dict[str, Column]], layout: Layout) -> DataFrame:
    """Add columns that look at most `before` rows back and `after` rows ahead along dim."""
    if not needs_blocks(sizes, dims, dim, layout):
        return df.withColumns(make(along(dims, dim)))
    p, b = F.col(pos(dim)), max(layout.block, before + after, 1)
    last = (sizes[dim] - 1) // b
    first_block = F.greatest(F.lit(0), F.floor((p - after) / b)).cast("long")
    final_block = F.least(F.lit(last), F.floor((p + before) / b)).cast("long")
    spread = df.withColumn(BLOCK, F.explode(F.sequence(first_block, final_block)))
    done = spread.withColumns(make(along(dims, dim, BLOCK)))
    return done.where(F.col(BLOCK) == F.floor(p / b)).drop(BLOCK)


def scan(
    df: DataFrame, dims: tuple[str, ...], dim: str, sizes: dict[str, int], layout: Layout, *,
    total: dict[str, Column], prefix: Callable[[WindowSpec], dict[str, Column]], local: Callable[[WindowSpec], dict[str, Column]], combine: dict[str, Column], backwards: bool = False,
) -> DataFrame:
    """Unbounded scans from the start of dim (from its end, if backwards).

    local: columns within a window that reaches from the start to the own row.
    In blocks: `total` aggregates a block, `prefix` folds the totals of earlier
    blocks, and `combine` overwrites local columns using prefix columns.
    """
    if not needs_blocks(sizes, dims, dim, layout):
        made = local(along(dims, dim))
        none = {k: F.lit(None) for k in prefix(along(dims, dim))}
        return df.withColumns(made).withColumns(none).withColumns(combine).drop(*none)
    keys = [pos(d) for d in dims if d != dim]
    blocked = df.withColumn(BLOCK, F.floor(F.col(pos(dim)) / layout.block))
    totals = blocked.groupBy(BLOCK, *keys).agg(*(c.alias(k) for k, c in total.items()))
    order = Window.partitionBy(*keys).orderBy(F.desc(BLOCK) if backwards else F.asc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumns(prefix(order)).select(BLOCK, *keys, *prefix(order))
    joined = blocked.join(carried, [BLOCK, *keys], "left")
    done = joined.withColumns(local(along(dims, dim, BLOCK))).withColumns(combine)
    return done.drop(BLOCK, *prefix(order))
