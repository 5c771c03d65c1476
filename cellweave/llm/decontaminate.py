"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A seed hashes the words that a fixed mask selects and ignores the others, so it
survives substitutions at ignored places. Seeds of all test items are joined to
seeds at every position of every document; at each hit the item is laid over
the document and compared word by word. An overlap counts if enough of the
item's words agree, or if a stretch does, with a penalty for each substitution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


@dataclass(frozen=True)
class Seeds:
    #: 1: the word is hashed, 0: ignored. Each has two hashed words side by side, the first such pair serves as a first filter.
    #: With these three no overlay that the verdict below accepts goes without a hit, whatever its length: agreeing pairs
    #: with no other such word within two places of them make less than 70 %, and a stretch of 12 holds three in a row.
    masks: tuple[str, ...] = ("111", "1101", "1011")
    #: An overlap is one where this share of the item's words agrees ...
    least_share: float = 0.7
    #: ... or where a stretch reaches this score: 1 for each equal word, and
    least_stretch: int = 12
    #: less this for each other.
    penalty: int = 2
    #: Items with fewer words are left out; those shorter than every mask must lie in the document as they are.
    least_words: int = 4
    #: Seeds of test items are broadcast up to this many (of 32 bytes), and joined by shuffle beyond.
    broadcast_seeds: int = 1_000_000
    #: So are the items themselves, up to this many bytes of text.
    broadcast_bytes: int = 32_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; empty for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def _at(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seed(w: Column, i: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *(F.get(w, i + j) for j in _at(mask)))


def _shapes(seeds: Seeds) -> list[tuple[int, str, int]]:
    """(number, mask, words before its pair): the masks, and contiguous ones for items shorter than all of them."""
    masks = list(enumerate(seeds.masks)) + [(1000 + n, "1" * n) for n in range(max(2, seeds.least_words), min(map(len, seeds.masks)))]
    return [(k, m, m.index("11")) for k, m in masks]


def item_words(benchmark: DataFrame, seeds: Seeds) -> DataFrame:
    """(item_id, b, m): the words of items that aren't left out, and their number."""
    return benchmark.where("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("b")).withColumn("m", F.size("b")).where(F.col("m") >= seeds.least_words)


def item_seeds(items: DataFrame, seeds: Seeds) -> DataFrame:
    """(pair, seed, item_id, m, j, shape) for every position at which a mask fits an item of m words; j is the position of its pair.

    Items shorter than every mask get, in their place, one contiguous mask of their own length.
    """
    parts = None
    for number, mask, lead in _shapes(seeds):
        fits = F.col("m") >= len(mask) if number < 1000 else F.col("m") == len(mask)
        rows = items.where(fits).select("item_id", "b", "m", F.explode(F.sequence(F.lit(lead), F.col("m") - len(mask) + lead)).alias("j"))
        part = rows.select(
            F.xxhash64(F.get("b", F.col("j")), F.get("b", F.col("j") + 1)).alias("pair"),
            _seed(F.col("b"), F.col("j") - lead, mask, number).alias("seed"), "item_id", "m", "j", F.lit(number).alias("shape"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _stretch(equal: Column, seeds: Seeds) -> Column:
    """The best score of a stretch: 1 for each True, -penalty for each False, never below 0."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, same: Column) -> Column:
        now = F.greatest(s["now"] + F.when(same, F.lit(1)).otherwise(F.lit(-seeds.penalty)), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(equal, start, step, lambda s: s["best"])


def overlaps(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """One row per document and test item that overlap: doc_id, item_id, start, n_equal, item_length.

    start is the word of the document at which the item's first word lies (it
    may be negative), taken from the best overlay. Null and empty texts and null
    ids overlap nothing; rows that repeat a doc_id or item_id count as one.
    """
    if any("11" not in m for m in seeds.masks) or not seeds.masks or seeds.least_words < 2:
        raise ValueError("every mask has two hashed words side by side, and every item two words")
    keep = Scratch(docs.sparkSession)
    items = keep.cut(item_words(benchmark.select("item_id", "text"), seeds), "items")
    keyed = keep.cut(item_seeds(items, seeds), "seeds")
    shapes = {r["shape"]: r["n"] for r in keyed.groupBy("shape").agg(F.count("*").alias("n")).collect()}
    size = items.agg(F.max("m").alias("longest"), F.sum(F.octet_length(F.concat_ws(" ", "b"))).alias("bytes")).first()
    hint = F.broadcast if sum(shapes.values()) <= seeds.broadcast_seeds else (lambda df: df)
    whole = F.broadcast if (size["bytes"] or 0) <= seeds.broadcast_bytes else (lambda df: df)
    spaces = [(k, m, lead) for k, m, lead in _shapes(seeds) if k in shapes]
    reach = int(size["longest"] or 0)
    w = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w"))
    # no filter on the number of words: it would be pushed down and split each text again
    places = w.select("doc_id", "w", F.explode(F.when(F.size("w") >= 2, F.sequence(F.lit(0), F.size("w") - 2))).alias("i"))
    pairs = keyed.select("pair").distinct()
    likely = places.withColumn("pair", F.xxhash64(F.get("w", F.col("i")), F.get("w", F.col("i") + 1))).join(hint(pairs), "pair", "left_semi")
    tried = F.array(*(_seed(F.col("w"), F.col("i") - lead, m, k) for k, m, lead in spaces)) if spaces else F.array().cast("array<long>")
    # from here on a place has only the words that an item laid over it can reach
    off = F.greatest(F.col("i") - reach, F.lit(0))
    near = likely.select("doc_id", "i", off.alias("off"), F.slice("w", off + 1, F.lit(2 * reach + 1)).alias("w"), F.explode(tried).alias("seed"))
    # several hits of one overlay are judged each: to tell them apart first would shuffle the words of all chance hits
    laid = near.join(hint(keyed.select("seed", "item_id", "j")), "seed").select("doc_id", "item_id", "w", "off", (F.col("i") - F.col("j")).alias("start"))
    # the item laid over the document: its word k against word start + k
    at = F.col("start") - F.col("off")
    equal = F.transform(F.col("b"), lambda b, k: F.coalesce((F.col("start") + k >= 0) & (F.get(F.col("w"), F.greatest(at + k, F.lit(0))) == b), F.lit(False)))
    # through a generator: else the verdict would become a condition of the join
    seen = laid.join(whole(items.select("item_id", "b")), "item_id").select("doc_id", "item_id", "start", F.explode(F.array(equal)).alias("equal"))
    judged = seen.select("doc_id", "item_id", "start", F.size("equal").alias("item_length"), F.size(F.filter("equal", lambda x: x)).alias("n_equal"), _stretch(F.col("equal"), seeds).alias("stretch"))
    good = judged.where((F.col("n_equal") >= F.ceil(F.col("item_length") * seeds.least_share)) | (F.col("stretch") >= seeds.least_stretch))
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", -F.col("start"), "item_length")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.col2")).alias("start"), F.col("best.n_equal").alias("n_equal"), F.col("best.item_length").alias("item_length"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """Documents that overlap no test item, all columns as they were; rows with a null doc_id stay."""
    bad = overlaps(docs, benchmark, seeds).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
