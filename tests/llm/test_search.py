"""Nearest neighbours against brute force, and the pipeline from end to end."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import ann


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string").repartition(3)


def nearest(vectors, q, k=5):
    v = {i: np.array(x, np.float32).astype(float) for i, x in vectors}
    s = sorted((-(v[i] @ v[q]) / (np.linalg.norm(v[i]) * np.linalg.norm(v[q])), i) for i in v if i != q)
    return [(i, -x) for x, i in s[:k]]


def test_pairs_rise_by_summed_distance():
    r = np.random.default_rng(0)
    index = ann.Index(2, (r.normal(size=(7, 2)), r.normal(size=(5, 2))), run=1)
    a, b = r.random(7).round(1), r.random(5).round(1)
    got = [(i, int(j)) for _, i, js in index.runs(a, b) for j in js]
    assert sorted(got) == [(i, j) for i in range(7) for j in range(5)]
    d = [a[i] + b[j] for i, j in got]
    assert d == sorted(d) and d[0] == heapq.nsmallest(1, [x + y for x in a for y in b])[0]
    index.run = 2
    sums = [(t, i, len(js)) for t, i, js in index.runs(a, b)]
    assert [t for t, _, _ in sums] == sorted(t for t, _, _ in sums) and sum(n for _, _, n in sums) == 35
    counts = r.integers(0, 4, (7, 5))
    first, second = (x.ravel() for x in np.indices((7, 5)))
    for wanted in (1, 10, 30, 10**6):
        reach = index.reach(a, b, counts, wanted)
        seen = counts.ravel()[index.visited(a, b, reach, first, second)].sum()
        less = counts.ravel()[index.visited(a, b, reach - 0.01, first, second)].sum()
        assert seen >= min(wanted, counts.sum()) and less < wanted


def test_search(spark):
    r = np.random.default_rng(1)
    good = [(i, r.normal(size=16)) for i in range(900)] + [(i, np.ones(16)) for i in range(900, 1300)]
    good += [(1300, 2 * np.ones(16))]
    odd = [(2000, None), (2050, np.zeros(16)), (2100, [None] + [1.0] * 15), (2150, [float("nan")] + [1.0] * 15), (2200, [float("inf")] + [1.0] * 15), (2250, [1.0, 2.0]), (None, np.ones(16))]
    df = table(spark, good + odd)
    df = df.unionByName(df.where("vec_id IN (3, 50)"))
    config = ann.Config(block_rows=100, chunk_queries=7, centroids=8)
    got = ann.search(df, F.col("vec_id") % 50 == 0, config=config).orderBy("query_id", "rank").collect()
    by = {}
    for x in got:
        by.setdefault(x["query_id"], []).append(x)
    assert set(by) == {i for i, _ in good if i % 50 == 0}
    hits = total = 0
    for q, rows in by.items():
        want = nearest(good, q)
        assert [x["rank"] for x in rows] == [1, 2, 3, 4, 5]
        assert [(-x["score"], x["vec_id"]) for x in rows] == sorted((-x["score"], x["vec_id"]) for x in rows)
        hits += len({x["vec_id"] for x in rows} & {i for i, _ in want})
        total += 5
    assert hits / total >= 0.9
    assert [x["vec_id"] for x in by[950]] == [900, 901, 902, 903, 904]
    whole = ann.search(df, F.col("vec_id") % 50 == 0, config=ann.Config(target=1.0, sample_queries=10**6, block_rows=64)).collect()
    exact = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in whole}
    for q in by:
        for k, (i, s) in enumerate(nearest(good, q), 1):
            assert abs(exact[q, k][1] - s) < 1e-9 and (exact[q, k][0] == i or abs(exact[q, k][1] - s) < 1e-12)


@pytest.mark.parametrize("data", ["/root/testdata/sf0.1", "clusters"])
def test_recall(spark, data):
    """Against brute force: on the given vectors, which lie in all directions, and on clustered ones, with the share that is visited."""
    r = np.random.default_rng(3)
    if data == "clusters":
        middle = r.normal(size=(60, 32))
        v = (middle[r.integers(0, 60, 6000)] + 0.25 * r.normal(size=(6000, 32))).astype(np.float32)
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    else:
        df = spark.read.parquet(f"{data}/embeddings.parquet")
        v = np.array([x["embedding"] for x in df.orderBy("vec_id").collect()], np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    got = {}
    for x in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x["query_id"], set()).add(x["vec_id"])
    assert set(got) == set(range(0, len(v), 50)) and all(len(x) == 5 for x in got.values())
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        hits += len(found & set(np.argsort(-s, kind="stable")[:5].tolist()))
    share = ann.fit(df.select("vec_id", F.col("embedding").alias("v")), len(v), ann.Config()).share
    assert hits / (5 * len(got)) >= 0.9
    assert share < (0.1 if data == "clusters" else 0.4)


def test_search_small(spark):
    few = table(spark, [(0, [1, 0]), (1, [1, 1]), (2, [0, 1])])
    got = [tuple(x)[:3] for x in ann.search(few, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0
    assert ann.search(table(spark, [(0, [1.0])]), F.lit(True)).count() == 0


def test_pipeline(spark):
    """What each stage drops and keeps is right for its own input."""
    import corpus_pipeline as p
    from cellweave.llm import minhash
    from cellweave.llm.common import cut

    sf = "/root/testdata/sf0.001"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").limit(1).first()["text"]
    base = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    extra = spark.createDataFrame([(9001, "12 34 +- 5", "en", "s", 9), (9002, None, None, "s", 0), (9003, f"Some words before. {bench} And some words after it.", "en", "s", 0), (9004, "Это предложение написано по русски и должно быть отвергнуто", None, "s", 0), (9005, "xkqzv wpfjt bnmqr zzkxw qwrtp sdfgh jklmn vbnxc rtwqp lkjhg zzxcv mnbvc qqwer", None, "s", 0)], base.schema)
    docs, kept = base.unionByName(extra), {}
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf), name)
        assert docs.columns == p.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert before - set(kept["language_id"]) == {9001, 9002, 9004, 9005}
    assert set(kept["line_dedup"]) == set(kept["language_id"])
    sets = {i: minhash.shingle_set(t, 5) for i, t in kept["line_dedup"].items()}
    ids = sorted(sets)
    linked = {b for n, a in enumerate(ids) for b in ids[n + 1 :] if (c := len(sets[a] & sets[b])) and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)}
    assert set(ids) - set(kept["near_dedup"]) == linked
    assert 9003 in kept["near_dedup"] and 9003 not in kept["decontamination"]
    assert p.run(spark, sf).schema == p.STAGES[-1][1](spark, docs, sf).schema
    pieces = p.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(kept["decontamination"])
