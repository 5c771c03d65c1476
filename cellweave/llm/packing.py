"""Vector bin packing of tokenised examples into fixed-length sequences.

Every example has a demand vector (tokens, segments, loss-bearing tokens) and
every sequence a capacity vector. Into the open sequence goes, again and again,
the pending example that fits and has the largest dot product of its demand with
the remaining capacity. Where nothing fits and cutting is allowed, the largest
pending example is cut so that its head fills the sequence.

Packing runs within each input partition with a bounded pool of pending
examples, so it needs no shuffle; a partition leaves at most one sequence that
is not full. A retried task packs the same rows in the same way.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches


class Encoder:
    """Ids of a byte-level BPE given by its ranks; the strings of special tokens become their ids.

    The same ids as the `tokenizers` library gives from the vocabulary's own file,
    four times as fast.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        if any(s in text for s in self._special):
            return self._bpe.encode(text, allowed_special="all")
        return self._bpe.encode_ordinary(text)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = 2048
    segments: int = 512
    loss_tokens: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], float)


@dataclass
class Piece:
    """A run of one example's ids. Its loss tokens are those where `loss` is set (all, if None)."""

    example: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None = None

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, at: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return Piece(self.example, self.start, self.ids[:at], a), Piece(self.example, self.start + at, self.ids[at:], b)


class Packer:
    """Places pieces into sequences; `pool` bounds how many wait at once."""

    def __init__(self, limits: Limits, *, cut: bool = True, min_cut: int = 16, pool: int = 1024):
        self.limits, self.cut, self.min_cut, self.pool = limits, cut, min_cut, pool
        self._cap = limits.vector()
        self._waiting: list[Piece] = []
        self._demands: list[tuple[int, int, int]] = []
        self._ready: list[Piece] = []

    def offer(self, piece: Piece) -> Iterator[list[Piece]]:
        """Take a piece; yield the sequences that this completes."""
        for part in self._sized(piece):
            if len(part.ids) == self.limits.tokens:
                yield [part]
            else:
                self._waiting.append(part)
                self._demands.append(part.demand())
        if len(self._waiting) > self.pool:
            yield from self._fill(self.pool // 2)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._fill(0)

    def _sized(self, piece: Piece) -> Iterator[Piece]:
        """Parts that fit into an empty sequence."""
        while piece is not None:
            n, lim = len(piece.ids), self.limits
            most = min(n, lim.tokens)
            if piece.loss is not None and piece.demand()[2] > lim.loss_tokens:
                most = min(most, int(np.searchsorted(np.cumsum(piece.loss), lim.loss_tokens, "right")))
            elif piece.loss is None:
                most = min(most, lim.loss_tokens)
            if most < n and not self.cut:
                raise ValueError(f"example {piece.example!r} exceeds a limit and cutting is off")
            if most == n:
                yield piece
                return
            head, piece = piece.split(most)
            yield head

    def _fill(self, down_to: int) -> Iterator[list[Piece]]:
        if not self._waiting:
            return
        demand = np.array(self._demands, float)
        alive, pieces = np.ones(len(demand), bool), self._waiting
        left = int(alive.sum())
        while left > down_to:
            room, inside = self._cap.copy(), []
            while left:
                fits = alive & (demand <= room).all(axis=1)
                if fits.any():
                    score = np.where(fits, (demand / self._cap) @ (room / self._cap), -1.0)
                    best = int(score.argmax())
                    piece = pieces[best]
                    alive[best] = False
                    left -= 1
                elif self.cut and room[1] >= 1 and (gap := int(min(room[0], room[2]))) >= self.min_cut:
                    best = int(np.where(alive, demand[:, 0], -1).argmax())
                    at = gap if pieces[best].loss is None else min(int(room[0]), int(np.searchsorted(np.cumsum(pieces[best].loss), room[2], "right")))
                    if at >= len(pieces[best].ids):
                        break
                    piece, pieces[best] = pieces[best].split(at)
                    demand[best] = pieces[best].demand()
                else:
                    break
                inside.append(piece)
                room -= piece.demand()
            yield inside
        self._waiting = [p for p, keep in zip(pieces, alive, strict=True) if keep]
        self._demands = [tuple(map(int, d)) for d in demand[alive]]


SCHEMA = "sequence_id long, offset long, doc_id long, start long, length long, loss_tokens long, doc_tokens long, ids_crc32 long"


def pack(
    docs: DataFrame, *, ranks_path: str, pattern: str, special: dict[str, int], end_id: int | None = 1, limits: Limits = Limits(),
    with_ids: bool = False, cut: bool = True, min_cut: int = 16, pool: int = 1024, parts: str | None = None,
) -> DataFrame:
    """Tokenise (doc_id, text) and pack; one row per piece.

    `special` maps the strings that the tokenizer reads as one id. end_id, if
    not None, follows each text's ids and bears loss as they do. All ids bear
    loss, unless `parts` names a column array<struct<text, loss>>: an example is
    then made of its parts' ids, which bear loss where the part does (null: not),
    and the text column isn't read. Null text, null parts and null texts of parts
    are empty: their document is the end id alone. Repeated rows are packed each.
    With with_ids, a column `ids` holds the piece's ids, and with parts, `loss`
    which of them bear loss. Other columns are ignored.
    """
    fields = SCHEMA + (", ids array<int>" if with_ids else "") + (", loss array<boolean>" if with_ids and parts else "")

    def run(reader: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(ranks_path, pattern, special)
        packer, sequence = Packer(limits, cut=cut, min_cut=min_cut, pool=pool), TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def note(bins: Iterable[list[Piece]]) -> None:
            nonlocal sequence
            for inside in bins:
                offset = 0
                for p in inside:
                    doc, total = p.example
                    out.append((sequence, offset, doc, p.start, len(p.ids), p.demand()[2], total, zlib.crc32(p.ids.astype("<u4").tobytes())) + ((p.ids.astype(np.int32),) if with_ids else ()) + ((p.loss,) if with_ids and parts else ()))
                    offset += len(p.ids)
                sequence += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + ([pa.list_(pa.int32())] if with_ids else []) + ([pa.list_(pa.bool_())] if with_ids and parts else [])
            names = [x.split()[0] for x in fields.split(", ")]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return batch

        def example(value) -> tuple[list[int], np.ndarray | None]:
            if not parts:
                return encode(value or "") + ([] if end_id is None else [end_id]), None
            ids, loss = [], []
            for part in value or ():
                own = encode((part and part["text"]) or "")
                ids += own
                loss += [bool(part and part["loss"])] * len(own)
            if end_id is not None:
                ids.append(end_id)
                loss.append(loss[-1] if loss else False)
            return ids, np.array(loss, bool)

        for batch in batches(reader, 256):
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, loss = example(value)
                if ids:
                    note(packer.offer(Piece((doc, len(ids)), 0, np.array(ids, np.uint32), loss)))
            if len(out) >= 4096:
                yield flush()
        note(packer.finish())
        if out:
            yield flush()

    return docs.select("doc_id", parts or "text").mapInArrow(run, fields)


def conversation_parts(turns: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",), turns_each: int = 256) -> DataFrame:
    """Examples (doc_id, part, parts) for pack() from rows (conv_id, turn, role, text): loss is borne by the turns of some roles.

    A conversation of more than turns_each turns, counted by their numbers, makes
    several examples (part 0, 1, ...), so that none is gathered without bound.
    Each turn is its role and text on lines of their own. Rows with a null conv_id
    or turn are left out; a null text is empty; rows that repeat a turn stay, in
    order of role and text. Other columns are ignored.
    """
    line = F.concat(F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    told = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), line.alias("text"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"))
    some = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    part = F.floor(F.col("turn") / turns_each).cast("long")
    # rows that repeat a turn many times are dealt by hash, too
    salt = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    kept = some.withColumn("__s", F.floor(salt / turns_each).cast("long")).groupBy(F.col("conv_id").cast("long").alias("doc_id"), part.alias("part"), "__s").agg(F.array_sort(F.collect_list(told)).alias("t"))
    return kept.select("doc_id", "part", F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss"))).alias("parts"))
