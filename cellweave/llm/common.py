"""What the operators share: tables, the shared folder, and text conventions."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch, cut, remove, shared_path, shared_root

__all__ = ["Scratch", "ascii_lower", "batches", "cut", "few", "one_thread", "only", "remove", "shared_path", "shared_root", "table", "unused", "words_of"]

#: The bytes that separate words, and that are stripped around lines.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(column, UPPER, LOWER)


def ascii_lower_str(text: str) -> str:
    return text.translate(_LOWERED) if not text.isascii() else text.lower()


def words_of(text: str | None) -> list[str]:
    """Lower-cased maximal runs of characters outside SPACE."""
    if not text:
        return []
    low = ascii_lower_str(text)
    parts = low.split()
    # str.split also cuts at a few rarer characters: join those by hand
    if low.isascii() and not any(c in low for c in "\x1c\x1d\x1e\x1f"):
        return parts
    if any(c in low for c in _RARE):
        return [w for w in low.translate(_TO_SPACE).split(" ") if w]
    return parts


_RARE = "\x1c\x1d\x1e\x1f\x85\xa0                　"
_TO_SPACE = {ord(c): " " for c in SPACE}


def unused(names: list[str], base: str = "__text") -> str:
    """A column name that is none of these, in whatever case."""
    low = {n.lower() for n in names}
    while base.lower() in low:
        base += "_"
    return base


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; reads no further than that."""
    return df.limit(most + 1).count() <= most


def only(df: DataFrame, key: str, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows of df whose key is among ids (one column of that name, distinct longs).

    Up to `most` ids (8 MB) they are broadcast, so that the other rows of df move
    nowhere; beyond, both sides are shuffled.
    """
    return df.join(F.broadcast(ids) if few(ids, most) else ids, key, "left_semi")


def batches(reader, rows: int = 2048):
    """Arrow record batches in slices of a bounded number of rows."""
    for batch in reader:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def one_thread() -> None:
    """Keep numeric libraries in a worker to one thread; Spark has one task per core."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")
