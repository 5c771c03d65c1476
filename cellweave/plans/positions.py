"""0-based positions of coordinate labels, and the labels next to others, without putting a long axis into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .windows import pos

PART = "__part"


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of `order`, one range per value of PART; written, since its bounds come from a sample."""
    return cut(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), "ranged")


def number_sorted(df: DataFrame, order: list[Column], into: str, n: int, block: int) -> DataFrame:
    """Add the rank (from 0) of each row in `order`, which ties no two rows.

    Up to `block` rows one window does; beyond, rows are range-partitioned and
    each partition's numbers start at the count of all rows before it.
    """
    if n <= block:
        return df.withColumn(into, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    told = _ranged(df, order)
    sizes = told.groupBy(PART).agg(F.count("*").alias("__n"))
    # one row per partition
    starts = sizes.select(PART, F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(PART).orderBy(*order)).cast("long") - 1
    return told.withColumn(into, local).join(F.broadcast(starts), PART).withColumn(into, F.col(into) + F.col("__start")).drop(PART, "__start")


def number_rows(df: DataFrame, label: str, into: str, n: int, block: int) -> DataFrame:
    """Add the rank (from 0) of each row by column `label`, whose values are distinct."""
    return number_sorted(df, [F.col(label)], into, n, block)


def coordinate(df: DataFrame, dim: str, block: int) -> tuple[DataFrame, int]:
    """(label, position) of all labels of a dimension, and their number."""
    labels = df.select(dim).where(F.col(dim).isNotNull()).distinct()
    n = labels.count()
    return number_rows(labels, dim, pos(dim), n, block), n


def neighbours(known: DataFrame, asked: DataFrame, n: int, block: int) -> DataFrame:
    """asked (label, new) with `lo` and `hi`: the nearest of known (label, old) at or below, and at or above.

    lo and hi are structs (label, old), or missing. Both are running last values,
    one up and one down the labels. Beyond `block` labels in all (n) these run within
    ranges of labels, after which a range's open ends take the nearest known
    label of the ranges before and after it.
    """
    none = F.lit(None).cast("long")
    both = known.select("label", "old", none.alias("new"), F.struct("label", "old").alias("k")).unionByName(asked.select("label", none.alias("old"), "new", F.lit(None).alias("k")))
    many = n > block
    both = _ranged(both, [F.col("label")]) if many else both.withColumn(PART, F.lit(0))
    keys = [PART] if many else []
    own_last = F.col("new").isNotNull()

    def running(order: Column) -> Column:
        w = Window.partitionBy(*keys).orderBy(order, own_last)
        return F.last("k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    told = both.withColumns({"lo": running(F.asc("label")), "hi": running(F.desc("label"))}).where("new IS NOT NULL")
    if many:
        ends = both.groupBy(PART).agg(F.min("k").alias("least"), F.max("k").alias("most"))
        # one row per partition
        before = F.last("most", True).over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("least", True).over(Window.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1))
        told = told.join(F.broadcast(ends.select(PART, before.alias("before"), after.alias("after"))), PART)
        told = told.withColumns({"lo": F.coalesce("lo", "before"), "hi": F.coalesce("hi", "after")})
    return told.select("label", "new", "lo", "hi")
