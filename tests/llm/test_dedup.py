"""Near-dedup, line dedup and span dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cellweave.llm import lines, minhash, spans
from cellweave.llm.common import words_of
from cellweave.llm.graph import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).repartition(parts)


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def near_copies(base, n, seed, share=0.03):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(max(1, int(share * r.random() * len(w)))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute(rows, k, percent=80):
    sets = {i: minhash.shingle_set(t, k) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_words():
    assert words_of("A  b\tÉc\n\x1cd\xa0e") == ["a", "b", "Éc", "\x1cd\xa0e"]
    assert words_of(None) == words_of(" \n") == []
    assert minhash.shingle_set("one two", 5) == {("one", "two")}


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rows, n = [], 0
    for g in range(6):
        base = words(120, g)
        for t in [" ".join(base), *near_copies(base, 14, g, 0.25)]:
            rows.append((n, t))
            n += 1
    rows += [(n + i, " ".join(words(60, 100 + i))) for i in range(20)]
    n += 20
    rows += [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, rows[0][1].upper()), (None, rows[0][1]), (3, rows[3][1]), (n + 7, " ".join(words(20_000, 5))), (n + 8, " ".join(words(20_000, 5)[:-40]))]
    want, sizes = brute(rows, k)
    got = minhash.near_components(docs(spark, rows), minhash.Scheme(shingle_words=k)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["n_shingles"] == sizes[r["doc_id"]]


def test_stragglers_and_keep_one(spark):
    """A chain of texts in which the ends are linked only over the middle, and a large group."""
    base = words(200, 1)
    chain = [" ".join(base[i * 12 : i * 12 + 110]) for i in range(7)]
    rows = [(i, t) for i, t in enumerate(chain + near_copies(words(150, 2), 120, 3, 0.1))]
    want, _ = brute(rows, 2)
    scheme = minhash.Scheme(shingle_words=2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_components(docs(spark, rows), scheme).collect()}
    assert got == want
    kept = minhash.keep_one(docs(spark, rows), scheme)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)


def test_rows_that_repeat_an_id(spark):
    """The text with the smallest digest of its words counts for all rows of an id; equal sets in another order are linked, too."""
    import hashlib

    a, b = " ".join(words(80, 1)), " ".join(words(80, 2))
    first = min(a, b, key=lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest())
    other = b if first == a else a
    loop = [f"v{i}" for i in range(20)]
    rows = [(5, a), (5, b), (5, None), (7, first.upper()), (8, other), (9, " ".join([*loop, *loop[:2]])), (10, " ".join([*loop[1:], *loop[:3]])), (11, None), (11, first)]
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in minhash.near_components(docs(spark, rows), minhash.Scheme(shingle_words=2)).collect())
    assert got == sorted([(5, 5, 79), (5, 5, 79), (5, 5, 0), (7, 5, 79), (8, 8, 79), (9, 9, 20), (10, 9, 20), (11, 5, 0), (11, 5, 79)])


def test_large_cloud_of_near_copies(spark):
    """Pairs on both sides of the threshold, in components that no star of a bucket joins, and one very long centre."""
    r = random.Random(7)
    base = words(150, 11)
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        w = list(base)
        for _ in range(r.randrange(1, 24)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    long = words(30_000, 3)
    rows += [(1000 + i, " ".join(long[: 30_000 - 50 * i])) for i in range(4)]
    want, _ = brute(rows, 2)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_components(docs(spark, rows), minhash.Scheme(shingle_words=2)).collect()}
    assert got == want


def test_empty_tables(spark):
    none = docs(spark, [])
    assert minhash.near_components(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert spans.repeated_spans(none).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 80)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in got}
    assert set(got) == {i for a, b in edges if a != b for i in (a, b)}


def brute_lines(rows):
    owner = defaultdict(set)
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in rows:
        for s in (t or "").split("\n"):
            owner[key(s)].add(i)
    out = {}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [s for s in own if len(key(s)) < 10 or min(owner[key(s)]) == i]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("n_batches,fanout", [(1, 3), (4, 2), (5, 3)])
def test_lines(spark, n_batches, fanout):
    r = random.Random(9)
    stock = [f"This is line number {i}" for i in range(12)] + ["short", "  ", "ÀÉ long enough line", "\x0bTrimmed Line here \r", "\x85not stripped xx", "exactly10c", "ninechars"]
    rows = [(i, "\n".join(r.choice(stock) + r.choice(["", " ", "\t"]) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "\n".join(f"unique line {i}" for i in range(5000)) + "\nThis is line number 3"), (64, "THIS IS LINE NUMBER 3\nthis is line number 3")]
    want = brute_lines(rows)
    df = docs(spark, rows).withColumnRenamed("lang", "kept").withColumnRenamed("source", "gone")
    got = {x["doc_id"]: (x["lines_before"], x["lines_dropped"], x["kept"]) for x in lines.dedup_lines(df, n_batches=n_batches, fanout=fanout, buckets=3).collect()}
    assert got == want


def test_line_rows_that_repeat(spark):
    rows = [(1, "a repeated long line\nx"), (1, "a repeated long line\nx"), (1, "another text here\na repeated long line"), (2, "a repeated long line"), (None, "a repeated long line")]
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["lines_dropped"]) for x in lines.dedup_lines(docs(spark, rows)).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 1, 0), (False, 2, 1), (True, 0, 0)]


def test_run_store_levels(spark):
    store = lines.RunStore(spark, buckets=2, fanout=2)
    for b in range(5):
        keys = spark.createDataFrame([(b * 10 + i, 0, b, b) for i in range(10)] + [(0, 0, b, b)] * (b > 0), "h1 long, h2 long, first long, last long").withColumn("n", F.lit(1).cast("long"))
        told = store.add(keys.dropDuplicates(["h1", "h2"])).collect()
        assert sum(x["seen"] for x in told) == (1 if b else 0)
    assert [len(level) for level in store.levels] == [1, 0, 1]
    assert sum(x.count() for x in store.runs()) == 50
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cellweave_run_")]


def test_store_takes_batches_of_other_sessions(spark):
    """A store that is opened again knows the lines of earlier batches."""
    from cellweave.llm.common import shared_path

    r = random.Random(5)
    stock = [f"This is line number {i}" for i in range(60)]
    rows = [(i, "\n".join(r.choice(stock) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    want, path, got = brute_lines(rows), shared_path(spark, "store"), {}
    for k in range(4):
        store = lines.RunStore(spark, 2, 2, path) if not k else lines.RunStore.open(spark, path)
        own = docs(spark, rows[15 * k : 15 * k + 15])
        got |= {x["doc_id"]: (x["lines_before"], x["lines_dropped"], x["kept"]) for x in lines.dedup_lines(own, n_batches=2, store=store).collect()}
        for level in store.levels:  # as in a session that has not heard of them
            for name, _ in level:
                spark.sql(f"DROP TABLE {name}")
    assert got == want


def test_hot_line(spark):
    """One line in most documents, over several batches: it goes everywhere but in the first, and its rows meet in no single task."""
    rows = [(i, f"the same line everywhere\nline of document {i}\nline of some documents {i % 7}") for i in range(400)]
    want = brute_lines(rows)
    got = {x["doc_id"]: (x["lines_before"], x["lines_dropped"], x["kept"]) for x in lines.dedup_lines(docs(spark, rows)).collect()}
    assert got == want


def brute_spans(rows, least, n):
    where = defaultdict(list)
    for i, t in rows:
        for s, e, c in spans.runs(t, least, n):
            where[c].append((i, s, e))
    out = set()
    for found in where.values():
        first = min(found)
        out |= {(i, s, e, first[0], first[1]) for i, s, e in found if (i, s) != first[:2]}
    return out


def test_spans(spark):
    r = random.Random(2)
    sentence = lambda seed: " ".join(words(r.randrange(3, 9), seed)).capitalize() + r.choice([".", "!", "?"])
    passage = " ".join(sentence(1000 + i) for i in range(10))
    rows = []
    for i in range(12):
        before, after = " ".join(sentence(i * 50 + j) for j in range(6)), " ".join(sentence(i * 50 + 20 + j) for j in range(6))
        rows.append((i, f"{before} {passage}\n{after}" if i in (3, 5, 9) else f"{before}\n{after}"))
    rows += [(12, None), (12, ""), (13, "one. two."), (14, passage + " " + passage), (15, " ".join(sentence(j) for j in range(3000, 5000)))]
    got = {tuple(x) for x in spans.repeated_spans(docs(spark, rows)).collect()}
    assert got == brute_spans(rows, 2, 16)
    assert {g[0] for g in got} == {5, 9, 14} and {g[3] for g in got} == {3}
    kept = {x["doc_id"]: x["kept"] for x in spans.remove_repeats(docs(spark, rows).where("doc_id <> 12")).collect()}
    assert passage in kept[3] and passage not in kept[9] and kept[7] == rows[7][1]
    assert len(kept[9]) < len(rows[9][1]) - len(passage) * 0.9


def test_long_sentence_between_other_neighbours(spark):
    """A sentence of 16 words or more repeats alone; a shorter one does not."""
    long_, short = " ".join(words(60, 1)) + ".", " ".join(words(15, 2)) + "."
    rows = [(i, f"{' '.join(words(9, 10 + i))}. {long_} {' '.join(words(9, 20 + i))}. {short} {' '.join(words(9, 30 + i))}.") for i in range(3)]
    rows.append((3, f"{' '.join(words(9, 40))}. {long_}"))
    got = {tuple(x) for x in spans.repeated_spans(docs(spark, rows)).collect()}
    assert got == {(i, 1, 2, 0, 1) for i in (1, 2, 3)} == brute_spans(rows, 2, 16)
    kept = {x["doc_id"]: x["kept"] for x in spans.remove_repeats(docs(spark, rows)).collect()}
    assert kept[0] == rows[0][1] and all(kept[i] == rows[i][1].replace(long_ + " ", "").replace(long_, "") for i in (1, 2, 3))


def test_remove_repeats_odd_rows(spark):
    """Clashing names, null ids, repeated rows, rows of one id with different texts, an empty table."""
    long_ = " ".join(words(30, 1)) + "."
    rows = [(1, f"Begin. {long_} End."), (2, f"{long_} Other."), (2, f"{long_} Other."), (2, "Quite another text."), (None, long_), (3, None), (4, "")]
    df = docs(spark, rows).withColumnsRenamed({"lang": "__text", "source": "__gone", "n_chars": "__doc"}).withColumn("t", F.lit("t")).withColumn("kept", F.lit(0))
    got = sorted((str(x["doc_id"]), x["kept"]) for x in spans.remove_repeats(df).collect())
    assert got == sorted([("1", rows[0][1]), ("2", "Other."), ("2", "Other."), ("2", "Quite another text."), ("None", long_), ("3", ""), ("4", "")])
    assert spans.remove_repeats(df.limit(0)).count() == 0


def covered(rows, least, n):
    """Sentences of each row in any run at all, however long, that an earlier place has; shares no code with the operator."""
    places, sizes = defaultdict(set), {}
    for i, t in rows:
        parts = [p.lower().split() for p in re.split(r"(?<=[.!?])\s+|\n\s*", t)]
        assert all(parts)
        sizes[i] = len(parts)
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                content = " ".join(w for p in parts[a:b] for w in p)
                if content.count(" ") + 1 >= n and (b - a >= least or b - a == 1):
                    places[content].add((i, a, b))
    gone = defaultdict(set)
    for found in places.values():
        first = min(found)[:2]
        for i, a, b in found:
            if (i, a) != first:
                gone[i] |= set(range(a, b))
    return gone, sizes


def test_every_run_counts(spark):
    """Short sentences at the end of a repeated passage go with it, though no run of 16 words starts there."""
    r = random.Random(5)
    pool = [" ".join(words(r.choice([2, 3, 6, 9, 12, 20]), 500 + i)) + "." for i in range(40)]
    rows = []
    for i in range(30):
        a, own = r.randrange(30), " ".join(words(4, 900 + i)) + "."
        rows.append((i, " ".join([own, *pool[a : a + r.randrange(2, 9)], own.replace(".", "?")])))
    rows += [(30, "Aa bb cc dd ee ff gg hh. Ii jj kk ll mm nn oo pp. Qq rr. Ss."), (31, "Other. Aa bb cc dd ee ff gg hh. Ii jj kk ll mm nn oo pp. Qq rr. Ss. Then another.")]
    gone, sizes = covered(rows, 2, 16)
    assert gone[31] == {1, 2, 3, 4}
    got = defaultdict(set)
    for x in spans.repeated_spans(docs(spark, rows)).collect():
        got[x["doc_id"]] |= set(range(x["start"], x["stop"]))
    assert got == {i: g for i, g in gone.items() if g}
    kept = {x["doc_id"]: x for x in spans.remove_repeats(docs(spark, rows), spans_into="runs").collect()}
    for i, t in rows:
        parts = [t[a:b] for a, b in spans.sentences(t)]
        assert len(parts) == sizes[i] and kept[i]["kept"] == "".join(p for k, p in enumerate(parts) if k not in gone[i])
        assert {k for s in kept[i]["runs"] or () for k in range(s["start"], s["stop"])} == gone[i]
    assert kept[31]["kept"] == "Other. Then another." and {s["first_doc_id"] for s in kept[31]["runs"]} == {30}


def test_white_space_before_the_text(spark):
    """A text that begins with a line end does not repeat itself."""
    one, two = " ".join(words(20, 1)) + ".", " ".join(words(9, 2)) + ". " + " ".join(words(9, 3)) + "."
    rows = [(0, f"\n{one}"), (1, f" \n\n{two} End."), (2, f"{two} Else."), (3, f"\n \n{one}")]
    kept = {x["doc_id"]: x["kept"] for x in spans.remove_repeats(docs(spark, rows)).collect()}
    assert kept == {0: rows[0][1], 1: rows[1][1], 2: "Else.", 3: "\n \n"}


def test_sentences_are_the_text():
    for t in ("a. b? c!\n\nd", "", "no end", "x...  y\n", "\n\na."):
        assert "".join(t[a:b] for a, b in spans.sentences(t)) == t
    assert spans.sentences(None) == []


def test_hashes_are_stable():
    """Values differ neither between workers nor between runs."""
    s = minhash.Hasher(2)("the quick brown fox")
    assert hashlib.sha256(s.tobytes()).hexdigest() == hashlib.sha256(minhash.Hasher(2)("THE quick  brown fox").tobytes()).hexdigest()
    assert len(s) == 3
