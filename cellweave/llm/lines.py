"""Line dedup over levelled sorted runs of line hashes.

A run is a bucketed, sorted table of line keys seen so far with the smallest
document that holds each. Batches come in ascending order of doc_id. A batch's
distinct keys are merge-joined with the runs (no exchange on the runs' side):
keys found there are repeats, the others become a new run at level 0. When a
level holds `fanout` runs they are merged into one run of the next level.

A key is 128 bits (two seeded 64-bit hashes) of the stripped, lower-cased line.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, ascii_lower, remove, shared_path

KEY = ["h1", "h2"]
COLUMNS = "h1 LONG, h2 LONG, first LONG, last LONG, n LONG, seen BOOLEAN"
#: Keys that hold at least this part of a batch's lines are joined by broadcast: there are at most as many as its inverse.
HOT = 1000


class RunStore:
    """Sorted runs of keys in levels; keys of different runs are disjoint.

    A store given a path can be opened again from there, in another session, to
    take further batches; one without lasts until it is dropped.
    """

    def __init__(self, spark: SparkSession, buckets: int = 16, fanout: int = 3, path: str | None = None):
        if fanout < 2 or buckets < 1:
            raise ValueError("fanout must be 2 or more and buckets 1 or more")
        self.spark, self.buckets, self.fanout, self.path = spark, buckets, fanout, path
        self.levels: list[list[tuple[str, str]]] = []
        self._kept = path is not None
        self._root = (path or shared_path(spark, "runs")).rstrip("/")
        self._old: list[tuple[str, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RunStore:
        """A store as it was after its last batch; its tables are registered anew."""
        told = json.loads(spark.read.text(f"{path.rstrip('/')}/levels.json", wholetext=True).first()[0])
        store = cls(spark, told["buckets"], told["fanout"], path)
        store.levels = [[tuple(run) for run in level] for level in told["levels"]]
        for level in store.levels:
            for name, where in level:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {store.buckets} BUCKETS LOCATION '{where}'")
        return store

    def _write(self, df: DataFrame) -> tuple[str, str]:
        name = f"cellweave_run_{uuid.uuid4().hex}"
        path = f"{self._root}/{name}"
        (df.repartition(self.buckets, *KEY).write.format("parquet").option("path", path)
         .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name))
        return name, path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name).where(~F.col("seen")).select(*KEY) for level in self.levels for name, _ in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Anti-join a batch's distinct keys (h1, h2, first, last, n) with all runs, keep what is new as a run.

        Returns the batch's keys with `seen`: whether an earlier batch had them.
        """
        hits = keys.withColumn("seen", F.lit(False))
        for run in self.runs():
            found = run.withColumn("hit", F.lit(True))
            hits = hits.join(found, KEY, "left").withColumn("seen", F.col("seen") | F.col("hit").isNotNull()).drop("hit")
        made = self._write(hits.select(*KEY, "first", "last", "n", "seen"))
        self._place(0, made)
        self._note()
        return self.spark.read.schema(COLUMNS).parquet(made[1])

    def _place(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        old, merged = self.levels[level], None
        for name, _ in old:
            part = self.spark.table(name).where(~F.col("seen"))
            merged = part if merged is None else merged.unionByName(part)
        made = self._write(merged)
        # a batch's own run still tells which of its keys repeat: files go when the store is told to tidy up
        self._old += old
        self.levels[level] = []
        self._place(level + 1, made)

    def _note(self) -> None:
        """Write down the levels, after the runs themselves."""
        if self._kept:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(f"{self._root}/levels.json")
            out = where.getFileSystem(conf).create(where, True)
            out.write(bytearray(json.dumps({"buckets": self.buckets, "fanout": self.fanout, "levels": self.levels}).encode()))
            out.close()

    def tidy(self) -> None:
        """Delete runs that are merged into others; what add() returned for their batches can't be read any more."""
        for name, path in self._old:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)
        self._old = []

    def drop(self) -> None:
        """Delete all runs."""
        self.tidy()
        for level in self.levels:
            for name, _ in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []
        remove(self.spark, self._root)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line whose key has at least min_chars code points: doc_id, text hash, position, key."""
    key = line_key(F.col("line"))
    return (
        docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "t", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def repeated(own: DataFrame, store: RunStore, keep: Scratch) -> DataFrame:
    """Lines (doc_id, t, pos) of a batch (those columns, h1, h2) that an earlier batch or a smaller document of this one has; its keys join the store.

    Keys that hold much of the batch are joined by broadcast, so that no task has
    all lines of one; there are at most HOT of them.
    """
    keys = own.groupBy(*KEY).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    told = store.add(keys)
    total = told.agg(F.sum("n")).first()[0] or 0
    told = told.where(F.col("seen") | (F.col("first") != F.col("last"))).select(*KEY, "first", "seen", "n")
    bar = max(1, -(-total // HOT))
    hot = keep.cut(told.where(F.col("n") >= bar), "hot")
    far = F.col("seen") | (F.col("doc_id") != F.col("first"))
    often = own.join(F.broadcast(hot), KEY).where(far)
    rest = own.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(told.where(F.col("n") < bar), KEY).where(far)
    return often.select("doc_id", "t", "pos").unionByName(rest.select("doc_id", "t", "pos"))


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, n_batches: int = 4, fanout: int = 3, buckets: int | None = None, store: RunStore | None = None) -> DataFrame:
    """Add `lines_before`, `lines_dropped` and `kept` (text without repeated lines) to documents.

    A line whose key occurs in several documents stays only in the one with the
    smallest doc_id. Shorter keys stay everywhere. Null or empty text is one
    empty line and `kept` is "". A row with a null doc_id owns and loses nothing.
    Rows that repeat a doc_id count as one document; other columns pass through,
    save that own columns of the three result names are replaced.

    With a store, the documents come after all that it has seen, and lines that
    are in it go, too. Without, one is made and dropped; its buckets follow the
    number of lines, as many as there are shuffle partitions at least.
    """
    spark = docs.sparkSession
    keep = Scratch(spark)
    docs = docs.drop("lines_before", "lines_dropped", "kept")
    ids = docs.where(F.col("doc_id").isNotNull()).agg(F.percentile_approx("doc_id", [i / n_batches for i in range(1, n_batches)], 10000).alias("q")).first()
    bounds = sorted(set(ids["q"] or [])) if n_batches > 1 else []
    batch = F.lit(0)
    for b in bounds:
        batch = batch + (F.col("doc_id") > b).cast("int")
    lines = keep.cut(line_table(docs.select("doc_id", "text"), min_chars).withColumn("batch", batch), "lines", "batch")
    own_store = store or RunStore(spark, buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // 1_000_000)), fanout)
    dropped = None
    for b in range(len(bounds) + 1):
        found = repeated(lines.where(F.col("batch") == b).drop("batch"), own_store, keep)
        dropped = found if dropped is None else dropped.unionByName(found)
    gone = keep.cut(dropped.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("__gone")).withColumnsRenamed({"doc_id": "__doc", "t": "__t"}), "gone")
    own_store.drop() if store is None else own_store.tidy()
    keep.free(lines)
    joined = docs.join(gone, (docs["doc_id"] == gone["__doc"]) & (F.xxhash64(docs["text"]) == gone["__t"]), "left")
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    lost = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__lost")
    return (
        joined.withColumns({"__lines": split, "__lost": lost})
        .withColumns({
            "lines_before": F.size("__lines").cast("long"),
            "lines_dropped": F.size("__lost").cast("long"),
            "kept": F.when(F.size("__lost") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")),
        })
        .drop("__lines", "__lost", "__doc", "__t", "__gone")
    )
