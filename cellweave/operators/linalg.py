"""Matrix products: contraction over shared dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.windows import pos
from ..schema import Group


def contract(a: Group, an: str, b: Group, bn: str, into: str) -> Group:
    """Sum of products over all dimensions the two variables share; the others stay, a's first.

    Rows that hold a missing value make their sums missing, as in array products.
    """
    shared = [d for d in a.dims if d in b.dims]
    left = tuple(d for d in a.dims if d not in shared)
    right = tuple(d for d in b.dims if d not in shared)
    x = a.frame().select(*(c for d in left for c in (pos(d), d)), *(pos(d) for d in shared), F.col(an).cast("double").alias("__a"))
    y = b.frame().select(*(c for d in right for c in (pos(d), d)), *(pos(d) for d in shared), F.col(bn).cast("double").alias("__b"))
    joined = x.join(y, [pos(d) for d in shared]) if shared else x.crossJoin(y)
    product = F.col("__a") * F.col("__b")
    total = F.when(F.count(product) == F.count(F.lit(1)), F.sum(product)).alias(into)
    keys = [c for d in (*left, *right) for c in (pos(d), d)]
    df = joined.groupBy(*keys).agg(total) if keys else joined.agg(total)
    return Group((*left, *right), df, {into: F.col(into)}, {into: "float"})
