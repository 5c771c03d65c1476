"""Substring dedup over sliding runs of sentences.

A run is `least` or more consecutive sentences with at least `words` words, or one
sentence that has as many by itself. From every sentence the shortest run that starts
and the shortest that ends there are hashed (96 bits) and joined globally: together
they cover what all runs cover. The occurrence with the smallest (doc_id, sentence) is
the first, and every sentence that a later occurrence covers is removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, unused

#: A sentence ends at a line end, and at . ! ? before white space.
BOUNDARY = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence with its trailing white space; together they are the text."""
    if not text:
        return []
    ends = [m.end() for m in BOUNDARY.finditer(text)]
    starts = [0, *ends]
    ends.append(len(text))
    return [(a, b) for a, b in zip(starts, ends, strict=True) if b > a]


def runs(text: str | None, least: int, words: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, end sentence, normalised content) of every run."""
    if not text:
        return []
    parts = [text[a:b].lower().split() for a, b in sentences(text)]
    # white space before the first words is no sentence: with it, the run after it would repeat itself
    at = [k for k, p in enumerate(parts) if p]
    parts = [parts[k] for k in at]
    sizes, n = np.cumsum([0, *map(len, parts)]), len(parts)
    if sizes[-1] < words:
        return []
    ends = np.maximum(np.searchsorted(sizes, sizes[:-1] + words, "left"), np.arange(n) + least)
    # those that end at a sentence too: what is left at the end of a repeated passage may be too short to start one
    starts = np.minimum(np.searchsorted(sizes, sizes[1:] - words, "right") - 1, np.arange(n) + 1 - least)
    found = {(i, e) for i, e in enumerate(ends.tolist()) if e <= n} | {(i, e) for e, i in enumerate(starts.tolist(), 1) if i >= 0}
    # also alone: its neighbours may differ where it is repeated
    found |= {(i, i + 1) for i, p in enumerate(parts) if len(p) >= words}
    norm = [" ".join(p) for p in parts]
    return [(at[i], at[e - 1] + 1, " ".join(norm[i:e]).encode()) for i, e in sorted(found)]


def run_table(docs: DataFrame, least: int, words: int) -> DataFrame:
    """One row (h1, h2, doc_id, t, start, stop) per run; t is a hash of the whole text."""

    def go(reader) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches(reader, 256):
            h1, h2, ids, ts, starts, stops = [], [], [], [], [], []
            for doc, text, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for s, e, content in runs(text, least, words):
                    h = xxhash.xxh3_128_intdigest(content)
                    h1.append((h & (2**64 - 1)) - 2**63)
                    h2.append(((h >> 64) & (2**32 - 1)) - 2**31)
                    ids.append(doc)
                    ts.append(t)
                    starts.append(s)
                    stops.append(e)
            yield pa.record_batch([pa.array(h1, pa.int64()), pa.array(h2, pa.int32()), pa.array(ids, pa.int64()), pa.array(ts, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["h1", "h2", "doc_id", "t", "start", "stop"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t")).mapInArrow(go, "h1 long, h2 int, doc_id long, t long, start int, stop int")


def repeated_spans(docs: DataFrame, *, least: int = 2, words: int = 16, with_text: bool = False) -> DataFrame:
    """Every non-first occurrence of a repeated run: doc_id, start, stop, first_doc_id, first_start.

    Sentences are numbered from 0, stop is exclusive. Null texts, empty texts and
    null doc_ids have no runs. Rows that repeat a doc_id may have a run at the
    same place: that is one occurrence. with_text adds t, the xxhash64 of the text
    that holds the occurrence. Other columns are ignored.
    """
    found = cut(run_table(docs.select("doc_id", "text"), least, words), "runs")
    # written first, so that the join shuffles it by itself: Spark splits a hot key only between two plain shuffles
    first = cut(found.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("final")
    ).where("first <> final").select("h1", "h2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")), "firsts")
    return found.join(first, ["h1", "h2"]).where("doc_id <> first_doc_id OR start <> first_start").select("doc_id", *(["t"] if with_text else []), "start", "stop", "first_doc_id", "first_start")


def remove_repeats(docs: DataFrame, *, least: int = 2, words: int = 16, into: str = "kept", spans_into: str | None = None) -> DataFrame:
    """Add column `into`: the text without sentences that a non-first repeated run covers ("" for null).

    With `spans_into`, a column of that name holds those runs: an array of structs of
    start, stop, first_doc_id and first_start as `repeated_spans` gives them, null where
    nothing goes. Own columns of these names are replaced, all others and repeated rows pass
    through. Rows with a null doc_id lose nothing; of rows that repeat a doc_id
    with different texts each loses what is repeated in its own.
    """
    spans = repeated_spans(docs, least=least, words=words, with_text=True)
    keep = [c for c in docs.columns if c not in (into, spans_into)]
    run = ["start", "stop", *(["first_doc_id", "first_start"] if spans_into else [])]
    gone = spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct(*run)).alias("gone")).toDF("doc", "t", "gone").alias("g")
    by_name = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    n = len(keep)

    def go(reader) -> Iterator[pa.RecordBatch]:
        for batch in batches(reader, 256):
            out = []
            for text, cuts in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                lost = {i for c in cuts or () for i in range(c["start"], c["stop"])}
                out.append("".join(text[a:b] for i, (a, b) in enumerate(sentences(text)) if i not in lost) if lost else text or "")
            yield pa.record_batch([*(batch.column(i) for i in range(n)), pa.array(out, pa.string()), *([batch.column(n + 1)] if spans_into else [])], names=[*keep, into, *([spans_into] if spans_into else [])])

    own = docs.alias("d")
    here = (F.col("d.doc_id") == F.col("g.doc")) & (F.xxhash64("d.text") == F.col("g.t"))
    joined = own.join(gone, here, "left").select(*(F.col(f"d.`{c}`") for c in keep), F.col("d.text").alias(unused(keep)), F.col("g.gone").alias(unused(keep, "__gone")))
    return joined.mapInArrow(go, ", ".join([*(f"`{c}` {by_name[c]}" for c in keep), f"`{into}` string", *([f"`{spans_into}` array<struct<start:int,stop:int,first_doc_id:bigint,first_start:int>>"] if spans_into else [])]))
