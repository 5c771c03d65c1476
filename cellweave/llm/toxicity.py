"""Toxicity by maximum-scoring segments of token log-odds.

Words get log-odds of toxic against other labelled texts under an informative
Dirichlet prior, whose pseudo-counts follow each word's frequency in the whole
corpus. A text counts a word once, so that one text that repeats a word doesn't
make it telling. A word's log-odds, 0 where they lie within `least_z` standard
errors of that, less a constant, which makes a clean text drift down, are its score. One linear scan finds all maximal scoring segments of a
text. A segment's score S becomes an expected number of such segments in a clean
text of n words, K n exp(-lambda S): lambda solves sum p exp(lambda s) = 1 for the
words of clean text, K is the least that covers how often clean texts' best
segments reach a score. Segments expected less than once are significant; the sum
of their -log expectations is a text's evidence, which a logistic curve turns into
a probability. lambda, K and the curve come from one half of the labelled texts,
under log-odds learned from the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, unused

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Config:
    #: Labels are learned from at most about this many rows of each class, by hash of doc_id.
    rows_per_class: int = 10_000
    #: Words in fewer toxic texts than this aren't learned.
    least_texts: int = 2
    #: Standard errors within which a word's log-odds say nothing.
    least_z: float = 3.0
    #: What each word's score lies below its log-odds.
    drift: float = 0.5
    #: Pseudo-counts of the prior, for each word that a class has.
    prior: float = 0.1
    seed: int = 6


@dataclass
class Model:
    #: Log-odds of words; all others' are 0.
    odds: dict[str, float] = field(default_factory=dict)
    #: What each word's score lies below its log-odds.
    penalty: float = 0.5
    rate: float = 1.0  # lambda
    scale: float = 0.1  # K
    intercept: float = -30.0
    slope: float = 0.0

    @cached_property
    def scores(self) -> dict[str, float]:
        return {w: x - self.penalty for w, x in self.odds.items()}

    @cached_property
    def lexicon(self) -> frozenset[str]:
        """Words with a positive score."""
        return frozenset(w for w, x in self.scores.items() if x > 0)

    def evidence(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        """Sum over segments of -log of their expected number, where that is below 1."""
        if not segments:
            return 0.0
        floor = np.log(self.scale * max(n_words, 1))
        return float(sum(max(0.0, self.rate * s - floor) for _, _, s in segments))

    def probability(self, evidence: float | np.ndarray) -> float | np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -40, 40)))


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def maximal_segments(hits: list[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time.

    hits: (position, score, fall) of the words with positive score, ascending; fall
    is the sum of what the words since the last of them lose.
    """
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    total = 0.0
    # link[i]: the nearest earlier candidate whose left sum is smaller, or -1
    link: list[int] = []
    for at, score, fall in hits:
        total -= fall
        left, right, start, end = total, total + score, at, at + 1
        total = right
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= left:
                j = link[j]
            if j < 0 or found[j][1] >= right:
                break
            left, start = found[j][0], found[j][2]
            del found[j:], link[j:]
            j -= 1
        found.append((left, right, start, end))
        link.append(j)
    return [(s, e, r - x) for x, r, s, e in found]


def segments_of(words: list[str], model: Model) -> list[tuple[int, int, float]]:
    if model.lexicon.isdisjoint(words):
        return []
    get, low, fall, hits = model.scores.get, -model.penalty, 0.0, []
    for i, w in enumerate(words):
        s = get(w, low)
        if s > 0:
            hits.append((i, s, fall))
            fall = 0.0
        else:
            fall -= s
    return maximal_segments(hits)


def _count(texts: DataFrame, columns: list[str], vocabulary: frozenset[str] | None, every: str = "") -> DataFrame:
    """(word, n_<c>): the number of texts with the word where column c holds, for column `every` that of its places; combined in each task first."""

    def run(reader) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in columns]

        def out() -> pa.RecordBatch:
            names = sorted(set().union(*counts))
            batch = pa.record_batch([pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in counts)], names=["word", *(f"n_{c}" for c in columns)])
            for c in counts:
                c.clear()
            return batch

        for batch in batches(reader, 512):
            flags = [batch.column(i + 1).to_pylist() for i in range(len(columns))]
            for i, text in enumerate(batch.column(0).to_pylist()):
                words = tokens(text)
                own = set(words) if vocabulary is None else vocabulary.intersection(words)
                for c, f, name in zip(counts, flags, columns, strict=True):
                    if f[i]:
                        c.update(words if name == every else own)
            if sum(map(len, counts)) > 200_000:
                yield out()
        if any(counts):
            yield out()

    part = texts.select("text", *columns).mapInArrow(run, ", ".join(["word string", *(f"n_{c} long" for c in columns)]))
    return part.groupBy("word").agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in columns))


def _positive_root(scores: np.ndarray, rates: np.ndarray, penalty: float) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1 over known words and the rest."""
    rest = max(0.0, 1 - rates.sum())
    over = lambda x: float((rates * np.exp(np.minimum(x * scores, 700))).sum() + rest * np.exp(-x * penalty) - 1)
    lo, hi = 1e-6, 1.0
    while over(hi) < 0 and hi < 1e4:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if over(mid) < 0 else (lo, mid)
    return hi


def _scale(best: np.ndarray, n_words: np.ndarray, rate: float, least: int = 5) -> float:
    """The least K for which no more texts reach any score x than the K sum n exp(-rate x) expected.

    Were all clean texts alike, any x would give the same K. They are not: a word
    that few of them have comes often in those, so the tail decides. Scores that
    fewer than `least` texts, or one in 500, reach are left out.
    """
    total, out = n_words.sum(), 0.0
    tail = np.sort(best[best > 0])[::-1]
    for k in range(max(least, -(-len(best) // 500)), len(tail) + 1):
        out = max(out, k / (total * np.exp(-rate * tail[k - 1])))
    return float(np.clip(out, 0.01, 1e3))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one feature with a weak ridge, by Newton's method."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([(w * (p - y)).sum() + 1e-3 * a, (w * (p - y) * x).sum() + 1e-2 * b])
        h = w * p * (1 - p)
        m = np.array([[h.sum() + 1e-3, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1e-2]])
        step = np.linalg.solve(m, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-9:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, config: Config = Config()) -> Model:
    """Learn from labels (doc_id, toxic) where may_learn holds of doc_id; corpus frequencies come from all docs.

    Null labels, repeated rows and texts are used once or not at all. Without
    both classes the model finds nothing and scores everything near 0.
    """
    known = labels.where(may_learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model()
    share = {t: min(1.0, config.rows_per_class / n) for t, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit(config.seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(draw < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # the sample's size is bounded by rows_per_class, so it may be broadcast
    sample = cut(docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")
    half = F.pmod(F.xxhash64(F.lit(config.seed), "h"), F.lit(2)) == 0
    toxic = F.col("toxic") == 1
    # both classes; of one half alone; and every place of a word in the other half's clean texts
    flags = sample.select("text", toxic.alias("t"), (~toxic).alias("o"), (toxic & half).alias("ht"), (~toxic & half).alias("ho"), (~toxic & ~half).alias("p"))
    columns = ["t", "o", "ht", "ho", "p"]
    by_class = cut(_count(flags, columns, None, every="p"), "words")
    sums = by_class.agg(*(F.sum(f"n_{c}").alias(c) for c in columns)).first()
    n = {c: float(sums[c] or 0) for c in columns}
    if not all(n.values()):
        return Model()
    # words whose two rates are less than one standard error apart can't come to say anything
    x, y = F.col("n_t") + 0.5, F.col("n_o") + 0.5
    telling = F.abs(F.log(x / n["t"]) - F.log(y / n["o"])) >= F.sqrt(1 / x + 1 / y)
    rows = by_class.where(((F.col("n_t") >= config.least_texts) | (F.col("n_o") >= config.least_texts)) & telling).collect()
    if not rows:
        return Model()
    words = [r["word"] for r in rows]
    seen = {c: np.array([r[f"n_{c}"] for r in rows], float) for c in columns}
    everywhere = _count(docs.select("text", F.lit(True).alias("all")), ["all"], frozenset(words))
    in_corpus = {r["word"]: r["n_all"] for r in everywhere.collect()}
    size = max(docs.where("text IS NOT NULL").count(), 1)
    texts = max(sample.count(), 1)
    # shares of all that a class has, by corpus frequency
    share_of = np.array([in_corpus.get(w, 1) for w in words], float) / size * texts / (n["t"] + n["o"])

    def learned(t: str, o: str) -> np.ndarray:
        a_t, a_o = (np.maximum(config.prior * n[c] * share_of, 1e-6) for c in (t, o))
        odds = np.log((seen[t] + a_t) / (n[t] * (1 + config.prior))) - np.log((seen[o] + a_o) / (n[o] * (1 + config.prior)))
        odds[np.abs(odds) < config.least_z * np.sqrt(1 / (seen[t] + a_t) + 1 / (seen[o] + a_o))] = 0.0
        return odds

    told = lambda odds: {w: float(x) for w, x in zip(words, odds, strict=True) if x}
    model, odds = Model(odds=told(learned("t", "o")), penalty=config.drift), learned("ht", "ho")
    trial = Model(odds=told(odds), penalty=config.drift)
    if not trial.lexicon:
        odds, trial = learned("t", "o"), model
    if not trial.lexicon:
        return Model()
    trial.rate = _positive_root(odds - config.drift, (seen["p"] + 0.5) / n["p"] / 1.5, config.drift)
    other = sample.where(~half)
    clean = segment_scores(other, trial, ["toxic"]).where("toxic = 0").select("n_words", "best").collect()
    trial.scale = _scale(np.array([r["best"] for r in clean], float), np.array([r["n_words"] for r in clean], float), trial.rate)
    scored = segment_scores(other, trial, ["toxic"]).select("toxic", "evidence").collect()
    t, x = np.array([r["toxic"] for r in scored], float), np.log1p(np.array([r["evidence"] for r in scored], float))
    model.rate, model.scale = trial.rate, trial.scale
    model.intercept, model.slope = _logistic(x, t, np.where(t == 1, 1 / share[1], 1 / share[0]))
    return model


def segment_scores(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all, if None) with n_words, n_hits (words with a positive score), best (the best segment's score, or 0), evidence, toxicity (0 to 1) and segments.

    segments lists every significant passage as (first word, end word, score,
    expected number in a clean text). Null and empty texts have none and get the
    model's base probability. Own columns of these names are replaced.
    """
    made = {"n_words": "long", "n_hits": "long", "best": "double", "evidence": "double", "toxicity": "double", "segments": "array<struct<start:int,end:int,score:double,expected:double>>"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    by_name = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at = keep.index("text") if "text" in keep else len(keep)  # sent once
    schema = ", ".join([*(f"`{c}` {by_name[c]}" for c in keep), *(f"{k} {v}" for k, v in made.items())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(reader) -> Iterator[pa.RecordBatch]:
        for batch in batches(reader, 512):
            sizes, hits, best, evidence, segments = [], [], [], [], []
            for text in batch.column(at).to_pylist():
                words = tokens(text)
                found = segments_of(words, model)
                sizes.append(len(words))
                hits.append(sum(w in model.lexicon for w in words) if found else 0)
                best.append(max((x for _, _, x in found), default=0.0))
                evidence.append(model.evidence(found, len(words)))
                k = model.scale * max(len(words), 1)
                told = [{"start": s, "end": e, "score": x, "expected": float(k * np.exp(-model.rate * x))} for s, e, x in found]
                segments.append([d for d in told if d["expected"] < 1])
            yield pa.record_batch(
                [*(batch.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array(best, pa.float64()), pa.array(evidence, pa.float64()), pa.array(model.probability(np.array(evidence)), pa.float64()), pa.array(segments, kind)],
                names=[*keep, *made],
            )

    return docs.select(*keep, *([] if at < len(keep) else [F.col("text").alias(unused(keep))])).mapInArrow(run, schema)
