"""Records that arrive over time, appended to a store or binned as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..frame import Lattice
from ..operators.grouping import FIXED, parse_frequency
from ..sources import store


def append_records(stream: DataFrame, path: str, dims: list[str], variables: list[str], dim: str) -> DataStreamWriter:
    """Each micro-batch becomes records appended along `dim` of an existing store."""

    def add(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.append(Lattice.from_frame(batch, dims, variables), path, dim)

    return stream.writeStream.foreachBatch(add)


def resample_stream(stream: DataFrame, time: str, freq: str, variable: str, late: str, keys: list[str] | None = None) -> DataFrame:
    """Sum, mean, count, min and max per fixed-length bin of an event stream; bins close once the watermark passes.

    Bins are anchored at the epoch, as a stream's first timestamp isn't known.
    """
    n, unit = parse_frequency(freq)
    if unit not in FIXED:
        raise ValueError("streams are binned by fixed lengths")
    v = F.col(variable)
    aggs = [F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max")]
    binned = stream.withWatermark(time, late).groupBy(F.window(time, f"{n * FIXED[unit]} microseconds"), *(keys or []))
    return binned.agg(*aggs).select(F.col("window.start").alias(time), *(keys or []), "sum", "mean", "count", "min", "max")
