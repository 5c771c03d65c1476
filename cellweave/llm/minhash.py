"""MinHash near-dedup with odd sketches.

1. Each text becomes its set of hashed word shingles, with two kinds of MinHash
   samples: `bands * rows` independent ones make one key per band; the minima of
   `bins` equal ranges of one permutation are folded into an odd sketch, a bitmap
   in which every (range, minimum) flips one bit. Texts with equal sequences of
   words, told by a 128-bit BLAKE2 digest, form a class.
2. Classes meet in buckets of equal band keys. Each is paired with the smallest
   class of its bucket (a star, not all pairs).
3. The XOR of two odd sketches has a population count that gives the number of
   differing samples, most precisely at high similarity: pairs whose count is
   too high for the wanted similarity go.
4. What is left is confirmed on full sets of word shingles, not hashes.
5. Confirmed links give components. Where the other members of a bucket still
   belong to several, each outside the largest of these is compared by sketch with
   those of other components, in the first bucket that the two share, so that no
   link is lost to the choice of star centres. Pairs whose sketches agree well
   enough are confirmed as before.

With 40 bands of 6 rows a pair at exactly 0.8 misses all buckets with
probability (1 - 0.8 ** 6) ** 40 = 5e-6. The bound on the population count lies
`sigmas` standard deviations beyond its mean at the wanted similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches, one_thread, only, words_of
from .graph import connected_components

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd multipliers."""
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


@dataclass(frozen=True)
class Scheme:
    """Parameters of a near-dedup run; similarity is percent / 100."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    bins: int = 4096
    sketch_bits: int = 2048
    sigmas: float = 3.5

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def sketch_words(self) -> int:
        return self.sketch_bits // 64


class Hasher:
    """Sorted distinct shingle hashes of texts; word hashes are remembered up to a bound."""

    def __init__(self, shingle_words: int, remember: int = 200_000):
        import xxhash

        self.k, self._hash, self._most = shingle_words, xxhash.xxh3_64_intdigest, remember
        self._known: dict[str, int] = {}
        self._mult = _odd(7, shingle_words)

    def _word(self, word: str) -> int:
        h = self._known.get(word)
        if h is None:
            h = self._hash(word.encode())
            if len(self._known) < self._most:
                self._known[word] = h
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of(words_of(text))

    def of(self, words: list[str]) -> np.ndarray:
        n = len(words)
        if not n:
            return np.empty(0, U)
        w = np.fromiter(map(self._word, words), U, n)
        k = min(self.k, n)
        with np.errstate(over="ignore"):
            h = w[: n - k + 1] * self._mult[0]
            for j in range(1, k):
                h = h + w[j : n - k + 1 + j] * self._mult[j]
            return np.unique(_mix(h + U(k)))


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    """The shingles themselves: distinct runs of k words; with fewer words, the whole sequence; with none, nothing."""
    words = words_of(text)
    if not words:
        return set()
    return set(zip(*(words[j:] for j in range(k)), strict=False)) if len(words) >= k else {tuple(words)}


def odd_sketches(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketches (documents x words of 64 bits) of sorted nonempty sets, and how many samples each folds."""
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (flat >> U(32)) * U(scheme.bins) >> U(32)
    least = np.ones(len(flat), bool)
    least[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    doc, spot = doc[least], _mix(flat[least] + U(29)) % U(scheme.sketch_bits)
    flips = np.bincount(doc * scheme.sketch_bits + spot.astype(np.int64), minlength=len(sets) * scheme.sketch_bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(sets), -1), axis=1).view(np.int64), np.bincount(doc, minlength=len(sets))


def sign(sets: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """Band keys (documents x bands) of nonempty sets."""
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mult, add = _odd(11, scheme.samples), _odd(13, scheme.samples)
    low = np.empty((len(sets), scheme.samples), U)
    work = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for i in range(scheme.samples):
            np.bitwise_xor(flat, add[i], out=work)
            np.multiply(work, mult[i], out=work)
            low[:, i] = np.minimum.reduceat(work, starts)
        keys = (_mix(low).reshape(len(sets), scheme.bands, scheme.rows) * _odd(19, scheme.rows)).sum(axis=2, dtype=U)
        keys = _mix(keys + _odd(23, scheme.bands))
    return keys.view(np.int64)


SIGNED = "doc_id long, t long, n_shingles long, f1 long, f2 long, n_samples long, sketch array<long>, keys array<long>"


def _lists(values: np.ndarray, rows: list[int], n: int) -> pa.Array:
    """One list per row of n, null where the row isn't among rows."""
    width = values.shape[1] if len(rows) else 0
    has = np.zeros(n, bool)
    has[rows] = True
    offsets = np.concatenate([[0], np.cumsum(has * width)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel() if len(rows) else np.empty(0, np.int64)), mask=pa.array(~has))


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Hash of the text, set size, digest of the words, odd sketch and band keys per document; all but the first two null for an empty set."""

    def run(reader) -> Iterator[pa.RecordBatch]:
        one_thread()
        hashes = Hasher(scheme.shingle_words)
        for batch in batches(reader, 512):
            sets, prints = [], []
            for words in map(words_of, batch.column(1).to_pylist()):
                sets.append(hashes.of(words))
                prints.append(int.from_bytes(blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest(), "big") if words else None)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sketches, samples, group, size = [], [], np.zeros(len(sets), np.int64), [], 0
            for j, i in enumerate(full):
                group.append(sets[i])
                size += len(sets[i])
                if size >= 30_000 or j == len(full) - 1:
                    keys.append(sign(group, scheme))
                    s, n = odd_sketches(group, scheme)
                    sketches.append(s)
                    samples[full[j + 1 - len(group) : j + 1]] = n
                    group, size = [], 0
            half = lambda shift: pa.array([None if p is None else ((p >> shift) & (2**64 - 1)) - 2**63 for p in prints], pa.int64())
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), half(64), half(0), pa.array(samples),
                 _lists(np.concatenate(sketches) if full else np.empty((0, 0), np.int64), full, len(sets)), _lists(np.concatenate(keys) if full else np.empty((0, 0), np.int64), full, len(sets))],
                names=["doc_id", "t", "n_shingles", "f1", "f2", "n_samples", "sketch", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, SIGNED)


def plausible(a: str, b: str, scheme: Scheme) -> Column:
    """Whether the odd sketches in structs a and b (n_shingles, n_samples, sketch) leave the wanted similarity plausible.

    At similarity j the sets' union has u = (|a| + |b|) / (1 + j) shingles, which
    fill k (1 - exp(-u / k)) of k ranges, in a share j of which the minima agree.
    Taken relative to the number of samples the two sets should have, as the
    chance that lowers one lowers the other.
    """
    j, k, n = scheme.percent / 100, float(scheme.bins), float(scheme.sketch_bits)
    x, y = F.col(a), F.col(b)
    count = F.lit(0)
    for i in range(scheme.sketch_words):
        count = count + F.bit_count(F.get(x["sketch"], F.lit(i)).bitwiseXOR(F.get(y["sketch"], F.lit(i))))
    u = (x["n_shingles"] + y["n_shingles"]) / (k * (1 + j))
    filled = k * (1 - F.exp(-u))
    shared = 1 - u * F.exp(-u) / (1 - F.exp(-u))  # of filled ranges, those in which several shingles compete
    usual = k * (2 - F.exp(-x["n_shingles"] / k) - F.exp(-y["n_shingles"] / k))
    differing = F.greatest((x["n_samples"] + y["n_samples"]) * (1 - 2 * j * filled / usual), F.lit(0.0))
    chance = 4 * filled * j * (1 - j) * shared  # variance of the number of differing samples
    folded = n / 4 * (1 - F.exp(-4 * differing / n)) - differing * F.exp(-4 * differing / n)  # and of the count for a given number
    most = differing + scheme.sigmas * F.sqrt(chance + F.greatest(folded, F.lit(0.0)) * F.exp(4 * differing / n)) + 2
    return (F.least(x["n_shingles"], y["n_shingles"]) * 100 >= F.greatest(x["n_shingles"], y["n_shingles"]) * scheme.percent) & (count <= F.ceil(n / 2 * (1 - F.exp(-2 * most / n))))


#: Members of one star whose texts one copy of the centre's text serves.
PER_COPY = 64


def confirm(pairs: DataFrame, docs: DataFrame, several: DataFrame, scheme: Scheme, keep: Scratch) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.

    several: (id, t) for ids that have several texts, with the hash of the one that counts.

    The text of a travels once for up to PER_COPY of its pairs, ahead of the
    texts that it is compared with; a task holds two texts at a time.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = only(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids)
    counts = wanted.join(several, "id", "left").where("t IS NULL OR t = xxhash64(text)")
    texts = keep.cut(counts.select("id", "text").dropDuplicates(["id"]), "texts")
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_COPY).alias("copies"))
    dealt = pairs.join(copies, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"), "b")
    others = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "copy", "b", "text")
    centres = copies.join(texts.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"), F.lit(None).cast("long").alias("b"), "text")
    both = centres.unionByName(others).repartition("a", "copy").sortWithinPartitions("a", "copy", F.asc_nulls_first("b"))
    k, percent = scheme.shingle_words, scheme.percent

    def run(reader) -> Iterator[pa.RecordBatch]:
        own: set = set()
        for batch in batches(reader, 256):
            a, b, texts = (batch.column(c).to_pylist() for c in ("a", "b", "text"))
            good = []
            for i in range(len(a)):
                if b[i] is None:
                    own = shingle_set(texts[i], k)
                    continue
                other = shingle_set(texts[i], k)
                common = len(own & other)
                if common and 100 * common >= percent * (len(own) + len(other) - common):
                    good.append(i)
            yield pa.record_batch([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["src", "dst"])

    done = keep.cut(both.mapInArrow(run, "src long, dst long"), "links")
    keep.free(texts)
    return done


def first_shared(x: str, y: str, bands: int) -> Column:
    """The first band in which two lists of 31-bit keys agree."""
    return F.coalesce(*(F.when(F.get(x, F.lit(i)) == F.get(y, F.lit(i)), F.lit(i)) for i in range(bands)))


def strays(shared: DataFrame, first: DataFrame, reps: DataFrame, scheme: Scheme, keep: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that met in a bucket without one being its star's centre, if their sketches agree.

    shared: (key, band, doc_id, a) with a the centre; first: (id, component).
    """
    others = shared.where("doc_id <> a").join(first.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    labelled = keep.cut(others.select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("label")), "labelled")
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("labels")).where("labels > 1").select("key", "largest")
    # written, so that the joins below have plain shuffles on both sides: Spark splits a hot key only between these
    mixed = keep.cut(mixed, "mixed")
    rows = keep.cut(labelled.join(mixed, "key"), "rows")
    short = F.transform("keys", lambda k: k.bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    about = only(reps, "doc_id", rows.select("doc_id").distinct()).select("doc_id", F.struct("n_shingles", "n_samples", "sketch", short.alias("keys")).alias("s"))
    members = keep.cut(rows.join(about, "doc_id"), "members")
    outside = keep.cut(members.where("label <> largest").select("key", F.col("doc_id").alias("x"), F.col("label").alias("lx"), F.col("s").alias("sx")), "outside")
    differ = (F.col("lx") != F.col("label")) & ((F.col("label") == F.col("largest")) | (F.col("x") < F.col("doc_id")))
    near = outside.join(members, "key").where(differ & plausible("sx", "s", scheme) & (first_shared("sx.keys", "s.keys", scheme.bands) == F.col("band")))
    found = keep.cut(near.select(F.least("x", "doc_id").alias("a"), F.greatest("x", "doc_id").alias("b")).distinct(), "candidates")
    keep.free(labelled, mixed, rows, members, outside)
    return found


def near_components(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of docs.

    component_id is the smallest doc_id reachable over links. Null, empty and
    word-free texts have no shingles and are linked with nothing. Rows that repeat
    a doc_id are one document, whose text is the one with the smallest digest of
    its words; n_shingles is each row's own. A row whose doc_id is null is linked
    with nothing and has a null component_id. Columns other than doc_id and text
    are ignored.
    """
    docs = docs.select("doc_id", "text")
    keep = Scratch(docs.sparkSession)
    signed = keep.cut(signatures(docs, scheme), "signatures")
    full = signed.where("f1 IS NOT NULL AND doc_id IS NOT NULL")
    own = full.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "t")).alias("f"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    own = keep.cut(own.select("doc_id", "f.f1", "f.f2", "f.t", "lo", "hi"), "own")
    classes = keep.cut(own.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    to_rep = classes.select(F.col("rep").alias("doc_id"), "f1", "f2")
    reps = keep.cut(full.join(to_rep, ["doc_id", "f1", "f2"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "n_samples", "sketch", "keys"), "reps")
    keyed = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    stars = keep.cut(keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a <> z").select("key", "a"), "stars")
    shared = keep.cut(keyed.join(stars, "key"), "shared")
    pairs = keep.cut(shared.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sketches = only(reps, "doc_id", ids).select("doc_id", F.struct("n_shingles", "n_samples", "sketch").alias("s"))
    near = (
        pairs.join(sketches.withColumnsRenamed({"doc_id": "a", "s": "sa"}), "a")
        .join(sketches.withColumnsRenamed({"doc_id": "b", "s": "sb"}), "b")
        .where(plausible("sa", "sb", scheme))
        .select("a", "b")
    )
    near = keep.cut(near, "candidates")
    several = keep.cut(own.where("lo <> hi").select(F.col("doc_id").alias("id"), "t"), "several")
    links = confirm(near, docs, several, scheme, keep)
    first = keep.cut(connected_components(links, keep), "components")
    rest = strays(shared, first, reps, scheme, keep)
    found = confirm(rest, docs, several, scheme, keep)
    merged = (
        found.join(first.withColumnsRenamed({"id": "src", "component": "cs"}), "src", "left").join(first.withColumnsRenamed({"id": "dst", "component": "cd"}), "dst", "left")
        .select(F.coalesce("cs", "src").alias("src"), F.coalesce("cd", "dst").alias("dst"))
    )
    second = keep.cut(connected_components(merged, keep).select(F.col("id").alias("component"), F.col("component").alias("top")), "merged")
    alone = second.select(F.col("component").alias("id"), "component").join(first.select("id"), "id", "left_anti")
    final = first.unionByName(alone).join(second, "component", "left").select(F.col("id").alias("rep"), F.coalesce("top", "component").alias("top"))
    named = classes.join(final, "rep", "left").where("n > 1 OR top IS NOT NULL").select("f1", "f2", F.coalesce("top", "rep").alias("component"))
    # written on both sides, as before a join with a hot key
    component = own.join(keep.cut(named, "named"), ["f1", "f2"]).where("component <> doc_id").select("doc_id", "component")
    component = keep.cut(component, "linked")
    keep.free(stars, shared, pairs, several, near, links, found, rest, first, second, reps, classes, own)
    done = signed.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    return done.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """Documents without near copies: of each component the one with the smallest doc_id stays.

    Rows with a null doc_id stay. Of rows that repeat a doc_id all stay or go.
    """
    gone = near_components(docs, scheme).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
