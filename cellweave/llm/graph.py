"""Connected components by alternating large-star and small-star steps.

Edges never meet on the driver, nor a node's neighbours in one task's memory:
each step is a minimum per node (combined before the shuffle) joined back to the
edges, so a node of very high degree is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def _star(pairs: DataFrame) -> DataFrame:
    """pairs: (u, v). Every v, and u itself, is linked to the smallest of u and its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every end of an edge (src, dst): the smallest id reachable.

    Null ends and loops are ignored; an empty input gives an empty result. Each
    round's edges replace those of the round before; rounds go on until the edges
    are stars, after a number of rounds that grows with the logarithm of theirs.
    """
    keep = scratch or Scratch(edges.sparkSession)
    e = keep.cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        down = _star(large.where("src <> dst").distinct().select(F.col("src").alias("u"), F.col("dst").alias("v")))
        small = down.where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst")).unionByName(down.select(F.col("u").alias("src"), F.col("m").alias("dst")))
        old, e = e, keep.cut(small.where("src <> dst").distinct(), "edges")
        keep.free(old)
        now = _state(e)
        if now == before:
            break
        before = now
    return e.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(e.select(F.col("dst").alias("id"), F.col("dst").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
