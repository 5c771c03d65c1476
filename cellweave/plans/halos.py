"""Halo rows, boundaries and folds: rows copied next to the blocks that need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import HaloWidthError, compute_domains
from .windows import pos


def block_of(dim: str, size: int, blocks: int, at: Column | None = None) -> Column:
    """The near-equal block that a position falls in, the earlier blocks being the larger ones."""
    p = F.col(pos(dim)) if at is None else at
    base, more = divmod(size, blocks)
    big = more * (base + 1)
    return F.when(p < big, F.floor(p / (base + 1))).otherwise(more + F.floor((p - big) / max(base, 1))).cast("long")


def with_halo(df: DataFrame, dim: str, size: int, blocks: int, before: int, after: int, cyclic: bool = False) -> DataFrame:
    """Rows of every block and copies of those up to `before` ahead of it and `after` behind it.

    Columns: block, halo (a copy), and at (the position, beyond [0, size) for
    copies that wrap around). Halos may be wider than neighbouring blocks.
    """
    if before < 0 or after < 0 or cyclic and max(before, after) > size:
        raise HaloWidthError("a halo is neither negative nor wider than a cyclic dimension")
    own = df.withColumn("at", F.col(pos(dim)))
    parts = [own]
    if cyclic:
        parts += [own.where(F.col("at") >= size - before).withColumn("at", F.col("at") - size), own.where(F.col("at") < after).withColumn("at", F.col("at") + size)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(size - 1))
    lo, hi = block_of(dim, size, blocks, inside(F.col("at") - after)), block_of(dim, size, blocks, inside(F.col("at") + before))
    home = F.when((F.col("at") >= 0) & (F.col("at") < size), block_of(dim, size, blocks, inside(F.col("at"))))
    spread = rows.withColumn("block", F.explode(F.sequence(lo, hi)))
    return spread.withColumn("halo", ~F.coalesce(home == F.col("block"), F.lit(False)))


def with_halos(df: DataFrame, along: list[tuple[str, int, int, int, int, bool]]) -> DataFrame:
    """Halos on several dimensions, one after the other, so that corners come along.

    along: (dim, size, blocks, before, after, cyclic). `block` and `at` hold one
    field per dimension; a row is a copy if it is one on any of them.
    """
    if not along:
        raise ValueError("a halo needs a dimension")
    for i, (dim, size, blocks, before, after, cyclic) in enumerate(along):
        df = with_halo(df, dim, size, blocks, before, after, cyclic).withColumnsRenamed({"block": f"__b{i}", "at": f"__a{i}", "halo": f"__h{i}"})
    names = [a[0] for a in along]
    joined = lambda p: F.struct(*(F.col(f"{p}{i}").alias(n) for i, n in enumerate(names)))
    copy = F.lit(False)
    for i in range(len(along)):
        copy = copy | F.col(f"__h{i}")
    made = [f"__{x}{i}" for x in "bah" for i in range(len(along))]
    return df.withColumns({"block": joined("__b"), "at": joined("__a"), "halo": copy}).drop(*made)


def update_group(fields: list[DataFrame], keys: list[str], dim: str, size: int, blocks: int, before: int, after: int, cyclic: bool = False) -> DataFrame:
    """Halos of several fields on the same cells in one exchange: joined by their keys first, copied once."""
    if not fields:
        raise ValueError("a group update needs a field")
    rows = fields[0]
    for more in fields[1:]:
        rows = rows.join(more.select(*keys, *(c for c in more.columns if c not in rows.columns)), keys)
    return with_halo(rows, dim, size, blocks, before, after, cyclic)


def fold_fields(fields: list[DataFrame], keys: list[str], values: list[str], op: str = "sum") -> DataFrame:
    """Cell by cell the sum, minimum or maximum of fields of the same shape."""
    if not fields:
        raise ValueError("there are no fields")
    rows = fields[0].select(*keys, *values)
    for more in fields[1:]:
        rows = rows.unionByName(more.select(*keys, *values))
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[op]
    return rows.groupBy(*keys).agg(*(fold(v).alias(v) for v in values))


def partition_offsets(df: DataFrame) -> DataFrame:
    """(partition, n, offset): the rows of each partition and of all before it."""
    sizes = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
    # one row per partition
    earlier = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def boundary(df: DataFrame, dim: str, size: int, blocks: int) -> DataFrame:
    """First and last rows of every block."""
    edges = sorted({p for a, b in compute_domains(size, blocks) if b > a for p in (a, b - 1)})
    return df.where(F.col(pos(dim)).isin(edges)).withColumn("block", block_of(dim, size, blocks))


def fold(df: DataFrame, values: list[str], fold_dim: str, mirror_dim: str, sizes: dict[str, int], width: int = 1, side: str = "north", parity: int = 1) -> DataFrame:
    """Add `width` rows beyond one edge of fold_dim, mirrored along mirror_dim and multiplied by parity."""
    if width < 0 or width > sizes[fold_dim]:
        raise HaloWidthError("a fold is not wider than the dimension")
    if side not in ("north", "south") or parity not in (1, -1):
        raise ValueError("side is north or south, parity 1 or -1")
    y, x = F.col(pos(fold_dim)), F.col(pos(mirror_dim))
    n, m = sizes[fold_dim], sizes[mirror_dim]
    edge = df.where(y >= n - width if side == "north" else y < width)
    labels = df.select(pos(mirror_dim), mirror_dim).distinct()
    beyond = edge.drop(mirror_dim).withColumns({pos(fold_dim): 2 * n - 1 - y if side == "north" else -1 - y, pos(mirror_dim): m - 1 - x, fold_dim: F.lit(None).cast(dict(df.dtypes)[fold_dim]), **{v: F.col(v) * parity for v in values}})
    return df.unionByName(beyond.join(labels, pos(mirror_dim)).select(*df.columns))


def global_field(df: DataFrame, dim: str, size: int) -> DataFrame:
    """Rows in order of dim, after checking that its positions tile [0, size) exactly."""
    told = df.agg(F.min(pos(dim)).alias("a"), F.max(pos(dim)).alias("b"), F.countDistinct(pos(dim)).alias("n")).first()
    if size and (told["a"], told["b"], told["n"]) != (0, size - 1, size):
        raise ValueError(f"positions along {dim!r} do not tile [0, {size})")
    return df.orderBy(pos(dim))
