"""Language identification by a small byte convolutional network.

Bytes (A-Z lower-cased) are embedded; filters of several widths slide over a
fixed-length window; each filter's largest response goes into a softmax layer.
The network is trained in numpy, on the driver, on a bounded sample of labelled
windows. For prediction the embedding and the filters fold into tables of
responses per byte and per byte pair, so that a window costs a few gathers. A
text's probabilities are those of all its windows, weighted by their bytes.

One more class is learned from made-up text that is in no language: the sample's
own letters in another order, letters at random, other scripts, codes. A text's
share of it tells how little it resembles any known language; predictions are
among the languages alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, one_thread, unused

UNDETERMINED = "und"
#: The label of what is in no known language.
OTHER = ""
#: First and last letters of scripts that made-up text is drawn from.
SCRIPTS = ((0x430, 0x44F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
WIDTHS = (2, 3, 4)


@dataclass(frozen=True)
class Config:
    window: int = 256
    embedding: int = 8
    filters: int = 16
    #: Training reads at most this many texts of each language ...
    texts_per_language: int = 500
    #: ... and this many windows of each.
    windows_per_text: int = 3
    epochs: int = 8
    seed: int = 5


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x embedding
    filters: list[np.ndarray]  # for each width: width * embedding x filters
    bias: np.ndarray
    head: np.ndarray
    head_bias: np.ndarray
    window: int
    #: A text whose share of OTHER reaches this resembles no known language.
    bound: float = 1.0


def made_up(texts: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """One text in no language for each given one, of about its length."""
    out = []
    for i, raw in enumerate(texts):
        text, kind = raw.decode("utf-8", "ignore"), i % 4
        sizes = [max(1, len(w)) for w in text.split()] or [4]
        if kind == 0:
            letters = [c for c in text if not c.isspace()]
            rng.shuffle(letters)
            ends = np.cumsum(sizes)
            words = ["".join(letters[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
        elif kind == 1:
            words = ["".join(map(chr, rng.integers(97, 123, n))) for n in sizes]
        elif kind == 2:
            low, high = SCRIPTS[rng.integers(len(SCRIPTS))]
            words = ["".join(map(chr, rng.integers(low, high + 1, n))) for n in sizes]
        else:
            words = [bytes(rng.integers(0, 256, n, dtype=np.uint8)).hex() if rng.random() < 0.5 else "".join(rng.choice(list("ABCDEFGHIJabcdefghij0123456789+/=_"), 2 * n)) for n in sizes]
        out.append(" ".join(words).encode("utf-8")[: len(raw)])
    return out


def _windows(texts: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(texts), size), np.uint8)
    for i, t in enumerate(texts):
        out[i, : min(len(t), size)] = np.frombuffer(t[:size].lower(), np.uint8)
    return out


def _responses(net: Network, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled responses (windows x all filters) and the position of each maximum, by plain matrix products."""
    e = net.embed[x]
    pooled, where = [], []
    for w, f in zip(WIDTHS, net.filters, strict=True):
        n = x.shape[1] - w + 1
        patches = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
        r = patches @ f
        at = r.argmax(axis=1)
        where.append(at)
        pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
    return np.concatenate(pooled, 1) + net.bias, np.concatenate(where, 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(texts: list[bytes], labels: list[str], config: Config = Config()) -> Network:
    """Adam on cross-entropy; deterministic for equal input in equal order. The last class is OTHER."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(config.seed)
    if languages:
        made = made_up([texts[i] for i in rng.permutation(len(texts))[: -(-len(texts) // len(languages))]], rng)
        texts, labels = [*texts, *made], [*labels, *[OTHER] * len(made)]
    classes = [*languages, OTHER]
    k, e, n = len(classes), config.embedding, config.filters
    net = Network(
        languages, rng.normal(0, 0.5, (256, e)).astype("f4"), [rng.normal(0, 1 / np.sqrt(w * e), (w * e, n)).astype("f4") for w in WIDTHS],
        np.zeros(n * len(WIDTHS), "f4"), rng.normal(0, 0.1, (n * len(WIDTHS), k)).astype("f4"), np.zeros(k, "f4"), config.window,
    )
    net.embed[0] = 0
    if not languages:
        return net
    # as many short pieces as long ones, so that a few words suffice
    short = [t[: int(s)] for t, s in zip(texts, rng.integers(6, config.window // 2, len(texts)), strict=True)]
    x = np.concatenate([_windows(texts, config.window), _windows(short, config.window)])
    y = np.array([classes.index(c) for c in labels] * 2)
    weight = (1 / np.bincount(y, minlength=k))[y]
    weight = (weight / weight.mean()).astype("f4")
    params = [net.embed, *net.filters, net.bias, net.head, net.head_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(config.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            xb, b = x[rows], len(rows)
            raw, where = _responses(net, xb)
            act = np.maximum(raw, 0)
            grad = _softmax(act @ net.head + net.head_bias)
            grad[np.arange(b), y[rows]] -= 1
            grad *= weight[rows, None] / b
            back = (grad @ net.head.T) * (raw > 0)
            g_embed, g_filters = np.zeros_like(net.embed), []
            for i, w in enumerate(WIDTHS):
                own, at_ = back[:, i * n : (i + 1) * n], where[:, i * n : (i + 1) * n]
                codes = xb[np.arange(b)[:, None, None], at_[:, :, None] + np.arange(w)]  # b x n x w
                patch = net.embed[codes].reshape(b, n, w * e)
                g_filters.append(np.einsum("bn,bnp->pn", own, patch))
                g_patch = (own[:, :, None] * net.filters[i].T[None]).reshape(b * n * w, e)
                np.add.at(g_embed, codes.ravel(), g_patch)
            g_embed[0] = 0
            grads = [g_embed, *g_filters, back.sum(0), act.T @ grad, grad.sum(0)]
            step += 1
            rate = 0.01 * 0.5**epoch if epoch else 0.01
            for p, g, a, c in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)).astype("f4")
    net.bound = _bound(net, x, y == k - 1)
    return net


def _bound(net: Network, x: np.ndarray, made: np.ndarray) -> float:
    """Half-way, in log-odds, from the largest share of a given window to the middle one of those made up."""
    share = np.concatenate([_softmax(np.maximum(_responses(net, x[i : i + 512])[0], 0) @ net.head + net.head_bias)[:, -1] for i in range(0, len(x), 512)]).astype("f8")
    odds = np.log(share.clip(1e-12, 1 - 1e-7)) - np.log1p(-share.clip(1e-12, 1 - 1e-7))
    middle = (odds[~made].max() + np.median(odds[made])) / 2
    return float(1 / (1 + np.exp(-middle)))


class Predictor:
    """The network with its filters folded into response tables."""

    def __init__(self, net: Network):
        self.net, n, e = net, net.filters[0].shape[1], net.embed.shape[1]
        by_byte = [[net.embed @ f[j * e : (j + 1) * e] for j in range(w)] for w, f in zip(WIDTHS, net.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, n)
        self.first = np.concatenate([pair(*by_byte[0]), pair(*by_byte[1][:2]), pair(*by_byte[2][:2])], axis=1)
        self.third, self.second = by_byte[1][2], pair(*by_byte[2][2:])

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each window."""
        n, size = self.third.shape[1], x.shape[1]
        out = np.empty((len(x), 3 * n), "f4")
        for at in range(0, len(x), 16):  # stays in the cache
            xb = x[at : at + 16]
            pair = xb[:, :-1].astype(np.int32) * 256 + xb[:, 1:]
            r = self.first[pair]
            out[at : at + 16, :n] = r[:, :, :n].max(axis=1)
            out[at : at + 16, n : 2 * n] = (r[:, : size - 2, n : 2 * n] + self.third[xb[:, 2:]]).max(axis=1)
            out[at : at + 16, 2 * n :] = (r[:, : size - 3, 2 * n :] + self.second[pair[:, 2:]]).max(axis=1)
        return _softmax(np.maximum(out + self.net.bias, 0) @ self.net.head + self.net.head_bias)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its probability, and that of none; `und`, 0 and 1 for a null text and one without a letter."""
        net, size = self.net, self.net.window
        langs, scores, others = [UNDETERMINED] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if t and net.languages and any(map(str.isalpha, t))]
        if not todo:
            return langs, scores, others
        raw = [texts[i].encode("utf-8", "replace").lower() for i in todo]
        counts = np.array([-(-len(r) // size) for r in raw])
        x = np.frombuffer(b"".join(r.ljust(c * size, b"\0") for r, c in zip(raw, counts, strict=True)), np.uint8).reshape(-1, size)
        p = self.windows(x) * (x != 0).sum(axis=1, keepdims=True).clip(1)
        total = np.add.reduceat(p, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0)
        total /= total.sum(axis=1, keepdims=True)
        known = total[:, :-1] / np.maximum(total[:, :-1].sum(axis=1, keepdims=True), 1e-30)
        for i, best, row, other in zip(todo, known.argmax(axis=1), known, total[:, -1], strict=True):
            langs[i], scores[i], others[i] = net.languages[best], float(min(1.0, row[best])), float(min(1.0, other))
        return langs, scores, others


def fit(docs: DataFrame, may_learn: Column, config: Config = Config()) -> Network:
    """Train on a sample of rows where may_learn holds and lang is not null.

    The sample has at most about texts_per_language texts of each language, by
    hash of doc_id. Without any labelled text the network knows no language.
    """
    known = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [], config)
    draw = F.pmod(F.xxhash64(F.lit(config.seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        wanted = F.when(F.col("lang") == lang, F.lit(config.texts_per_language / n)).otherwise(wanted)
    size = config.window
    starts = [F.pmod(F.xxhash64(F.lit(w), "doc_id"), F.greatest(F.char_length("text") - size, F.lit(1)).cast("long")).cast("int") for w in range(config.windows_per_text)]
    rows = (
        known.where(draw < wanted)
        .select("doc_id", "lang", draw.alias("draw"), F.array(*(F.substring("text", s + 1, F.lit(size)) for s in starts)).alias("pieces"))
        .orderBy("draw", "doc_id", "lang")
        .limit(2 * config.texts_per_language * len(counts))
        .collect()
    )
    pieces = [(p.encode("utf-8", "replace"), r["lang"]) for r in rows for p in dict.fromkeys(r["pieces"]) if any(map(str.isalpha, p))]
    return train([p for p, _ in pieces], [c for _, c in pieces], config)


def predict(docs: DataFrame, net: Network, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all, if None) with lang_pred, lang_score and lang_other from column text.

    lang_pred is a learned language, or `und` with score 0 where text is null or
    has no letter. lang_other (0 to 1) tells how little the text resembles any
    learned language. Own columns of the three result names are replaced.
    """
    made = ["lang_pred", "lang_score", "lang_other"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    by_name = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    at = keep.index("text") if "text" in keep else len(keep)  # sent once
    schema = ", ".join([*(f"`{c}` {by_name[c]}" for c in keep), "lang_pred string", "lang_score double", "lang_other double"])

    def run(reader) -> Iterator[pa.RecordBatch]:
        one_thread()
        model = Predictor(net)
        for batch in batches(reader, 128):
            langs, scores, others = model.texts(batch.column(at).to_pylist())
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(others, pa.float64())], names=[*keep, *made])

    return docs.select(*keep, *([] if at < len(keep) else [F.col("text").alias(unused(keep))])).mapInArrow(run, schema)
