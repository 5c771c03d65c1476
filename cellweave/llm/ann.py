"""Approximate nearest neighbours with an inverted multi-index.

Vectors are normalised and cut into two halves, each quantised by a codebook of
its own (k-means on a bounded sample). A cell is a pair of centroids. For a
query, a heap yields pairs by rising sum of the two squared distances, in runs of
second centroids that are neighbours by distance, until the pairs seen hold the
wanted share of all vectors; the entries of these cells are reranked by exact
cosine in double precision. The share is not fixed: it is the least that finds
`target` of the true neighbours of a bounded sample of vectors among that sample.
Clustered vectors need few cells; of vectors spread evenly in all directions,
which no index tells apart, it is larger.

Entries lie in blocks of bounded size, made of whole small cells or of slices of
large ones; queries come in chunks of bounded size. A task holds one block and
one chunk at a time. A query goes to the blocks that hold a cell it visits, with
nothing but its vector and the largest sum that it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batches, one_thread


@dataclass(frozen=True)
class Config:
    #: Of each half; of a small table at most one for each 8 sampled vectors.
    centroids: int = 256
    #: Codebooks and the share are fitted to at most about this many vectors, by hash of vec_id ...
    sample: int = 20_000
    #: ... the share with this many of them as queries, so that this part of their neighbours is found.
    sample_queries: int = 256
    target: float = 0.95
    #: Second centroids that leave the heap together.
    run: int = 8
    block_rows: int = 16_384
    chunk_queries: int = 16_384
    rounds: int = 15
    seed: int = 8


@dataclass
class Index:
    half: int
    books: tuple[np.ndarray, np.ndarray]
    run: int = 8
    share: float = 1.0

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.books[0]), len(self.books[1])

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of normalised vectors' halves to the centroids, less the vectors' own norms."""
        return tuple((c * c).sum(1) - 2 * p @ c.T for c, p in zip(self.books, (v[:, : self.half], v[:, self.half :]), strict=True))

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = self.distances(v)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def floors(self, b: np.ndarray) -> np.ndarray:
        """For each second centroid the least distance in its run: runs are cut from the centroids by rising distance."""
        order = np.argsort(b, kind="stable")
        out = np.empty_like(b)
        out[order] = b[order][np.arange(len(b)) // self.run * self.run]
        return out

    def runs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, np.ndarray]]:
        """All pairs by rising sum: (sum, first centroid, second centroids of a run), from a heap.

        (i, j) enters the heap once both its neighbours towards the origin have
        left: i counts first centroids by rising distance, j runs of second ones.
        """
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        groups = [ob[k : k + self.run] for k in range(0, len(ob), self.run)]
        sa, sb = a[oa].tolist(), [float(b[g[0]]) for g in groups]
        n, m = len(sa), len(sb)
        heap, left = [(sa[0] + sb[0], 0, 0)], [0] * n  # left[i]: how many runs of row i have left
        while heap:
            total, i, j = heapq.heappop(heap)
            left[i] = j + 1
            yield total, int(oa[i]), groups[j]
            if i + 1 < n and left[i + 1] == j:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
            if j + 1 < m and (i == 0 or left[i - 1] > j + 1):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))

    def reach(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: float) -> float:
        """The sum at which the runs seen hold `wanted` entries; counts: entries of each cell, as a table."""
        order = np.argsort(b, kind="stable")
        padded = np.zeros((len(a), -(-len(b) // self.run) * self.run), counts.dtype)
        padded[:, : len(b)] = counts[:, order]
        held = padded.reshape(len(a), -1, self.run).sum(axis=2).tolist()
        at, seen, last = {int(c): k // self.run for k, c in enumerate(order)}, 0, -np.inf
        for total, first, second in self.runs(a, b):
            last = total
            seen += held[first][at[int(second[0])]]
            if seen >= wanted:
                break
        return last

    def visited(self, a: np.ndarray, b: np.ndarray, reach: float, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Which of the cells (first, second) a query with these distances visits."""
        return a[first] + self.floors(b)[second] <= reach


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt(np.add.reduce(v * v, axis=1))[:, None]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def usable(vector: str) -> Column:
    """Vectors that take part: not null, no null or non-finite component, some component not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def fit(vectors: DataFrame, n: int, config: Config) -> Index:
    """Codebooks and share from a sample of the usable vectors, of which there are about n."""
    draw = F.pmod(F.xxhash64(F.lit(config.seed), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = vectors.where(draw < config.sample / max(n, 1)).select("vec_id", "v").orderBy(draw, "vec_id").limit(2 * config.sample).collect() or vectors.select("vec_id", "v").orderBy("vec_id").limit(config.sample).collect()
    x = _unit(np.array([r["v"] for r in rows], float))
    half = max(1, x.shape[1] // 2)
    rng = np.random.default_rng(config.seed)
    # the share is fitted to vectors that the codebooks haven't seen, unless they see all that there are
    learn, hold = (x, x) if n <= config.sample else (x[::2], x[1::2])
    k = max(1, min(config.centroids, len(learn) // 8))
    index = Index(half, (_kmeans(learn[:, :half], k, config.rounds, rng), _kmeans(learn[:, half:], k, config.rounds, rng)), config.run)
    index.share = _least_share(index, hold, config)
    return index


def _least_share(index: Index, x: np.ndarray, config: Config, k: int = 5) -> float:
    """The least share of x, by order of visit, that holds the target part of the k nearest of some of x."""
    if len(x) <= k + 1:
        return 1.0
    cell = index.cells(x)
    first, second = np.divmod(cell, len(index.books[1]))
    shares = []
    for q in range(0, len(x), max(1, len(x) // config.sample_queries)):
        near = x @ x[q]
        near[q] = -np.inf
        true = np.argpartition(-near, k)[:k]
        a, b = index.distances(x[q : q + 1])
        sums = a[0][first] + index.floors(b[0])[second]
        shares += [float((sums <= sums[t]).mean()) for t in true]
    return float(np.quantile(shares, config.target, method="higher"))


def _best(ids: np.ndarray, v: np.ndarray, norms: np.ndarray, qid: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
    """The k entries nearest to q, by exact cosine, ties to smaller ids; q's own row is none."""
    other = ids != qid
    if not other.all():
        ids, v, norms = ids[other], v[other], norms[other]
    if not len(ids):
        return []
    rough = (v @ q) / norms
    if len(ids) > k:
        bar = np.partition(rough, len(ids) - k)[len(ids) - k]
        near = rough >= bar - 1e-9 * abs(bar) - 1e-12
        ids, v, norms = ids[near], v[near], norms[near]
    # row by row in a fixed order, so that equal vectors score equally
    score = np.add.reduce(v * q, axis=1) / (norms * np.sqrt(np.add.reduce(q * q)))
    order = np.lexsort((ids, -score))[:k]
    return [(int(ids[i]), float(score[i])) for i in order]


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, config: Config = Config(), vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found to each row where is_query holds.

    Vectors that are null or zero, or hold a null or non-finite component, take
    no part; nor do those whose length isn't the commonest one (the smaller, on
    a tie), or whose vec_id is null. Of rows that repeat a vec_id one counts. A
    query's own row is no candidate. Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("query")).where(F.col("vec_id").isNotNull() & usable("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = good.groupBy(F.size("v").alias("d")).count().collect()
    if not sizes:
        return empty
    dim = max(sizes, key=lambda r: (r["count"], -r["d"]))["d"]
    good = good.where(F.size("v") == dim).dropDuplicates(["vec_id"])
    index = fit(good, max(r["count"] for r in sizes), config)
    n_first, width = index.shape
    keep = Scratch(spark)

    def place(reader) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches(reader, 4096):
            if batch.num_rows:
                x = _unit(_matrix(batch.column("v")))
                yield pa.record_batch([*batch.columns, pa.array(index.cells(x).astype(np.int32))], names=["vec_id", "v", "query", "cell"])

    kind = good.schema["v"].dataType.simpleString()
    placed = keep.cut(good.mapInArrow(place, f"vec_id long, v {kind}, query boolean, cell int"), "cells")
    # at most centroids ** 2 rows
    told = placed.groupBy("cell").count().collect()
    counts = np.zeros(n_first * width, np.int64)
    counts[[r["cell"] for r in told]] = [r["count"] for r in told]
    n_queries = placed.where("query").count()
    first, slices, at, filled = np.full(n_first * width, -1), np.zeros(n_first * width, np.int64), 0, 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if filled and filled + n > config.block_rows:
            at, filled = at + 1, 0
        first[cell], slices[cell] = at, max(1, -(-n // config.block_rows))
        filled += n
        if slices[cell] > 1:
            at, filled = at + int(slices[cell]), 0
    chunks = max(1, -(-n_queries // config.chunk_queries))
    layout = spark.createDataFrame([(int(c), int(first[c]), int(slices[c])) for c in np.flatnonzero(counts)], "cell int, first int, slices int")
    entries = placed.join(F.broadcast(layout), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("slices")).cast("int")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "v", "cell")
    # the query itself is an entry, too
    wanted = index.share * counts.sum() + 1
    filled_cells = np.flatnonzero(counts)

    def visit(reader) -> Iterator[pa.RecordBatch]:
        one_thread()
        table, (own_first, own_second) = counts.reshape(n_first, width), np.divmod(filled_cells, width)
        for batch in batches(reader, 64):
            if not batch.num_rows:
                continue
            a, b = index.distances(_unit(_matrix(batch.column("v"))))
            rows, blocks, reaches = [], [], []
            for r in range(batch.num_rows):
                reach = index.reach(a[r], b[r], table, wanted)
                cells = filled_cells[index.visited(a[r], b[r], reach, own_first, own_second)]
                more = slices[cells].max(initial=1)
                found = np.unique(np.concatenate([first[cells] + np.minimum(s, slices[cells] - 1) for s in range(more)]))
                rows += [r] * len(found)
                blocks.append(found)
                reaches += [reach] * len(found)
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([pa.array(np.concatenate(blocks).astype(np.int32)), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(reaches, pa.float64())], names=["block", "query_id", "q", "reach"])

    asked = placed.where("query").select("vec_id", "v").mapInArrow(visit, f"block int, query_id long, q {kind}, reach double")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(chunks)).cast("int"))

    def rerank(block: pa.Table, queries: pa.Table) -> pa.Table:
        one_thread()
        out: list[tuple[int, int, float]] = []
        if block.num_rows and queries.num_rows:
            ids, v, cell = block.column("vec_id").to_numpy(), _matrix(block.column("v").combine_chunks()), block.column("cell").to_numpy()
            order = np.lexsort((ids, cell))
            ids, v = ids[order], v[order]
            norms = np.sqrt(np.add.reduce(v * v, axis=1))
            there, at = np.unique(cell[order], return_inverse=True)
            own_first, own_second = np.divmod(there, width)
            q = _matrix(queries.column("q").combine_chunks())
            for k0 in range(0, len(q), 64):
                # the last digits of a sum may depend on the batch it is computed in
                a, b = index.distances(_unit(q[k0 : k0 + 64]))
                for r, (qid, reach) in enumerate(zip(queries.column("query_id")[k0 : k0 + 64].to_pylist(), queries.column("reach")[k0 : k0 + 64].to_pylist(), strict=True)):
                    mine = index.visited(a[r], b[r], reach + 1e-9, own_first, own_second)[at]
                    out += [(qid, i, s) for i, s in _best(ids[mine], v[mine], norms[mine], qid, q[k0 + r], k)]
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "score"])

    found = entries.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
