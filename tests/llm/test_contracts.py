"""The registered queries on the smallest tables: columns, types, rows, and values by ways that share no code with the operators."""

import hashlib
import html as decoder
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op10_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


def table(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def results(spark):
    queries, done = __spark_entry__.queries(), {}

    def get(name):
        if name not in done:
            df = queries[name](spark, SF)
            done[name] = (dict(df.dtypes), df.toPandas())
        return done[name]

    return get


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(results, name):
    types, rows = results(name)
    assert COLUMNS[name].items() <= types.items()
    assert len(rows)


def test_every_query_is_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(re.sub(r"_.*", "", n) for n in names) == sorted([*(f"op{i}" for i in range(1, 11)), "pipeline"])


@pytest.mark.parametrize("name", ["op1_minhash", "op9_line_dedup"])
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_sql(spark, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, sf).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").astype(str).to_numpy().tolist() == want.sort_values("doc_id").astype(str).to_numpy().tolist()


def test_held_out(results):
    for name, n, k in (("op5_language_id", 4, 2), ("op6_toxicity", 5, 0)):
        rows = results(name)[1]
        assert sorted(rows.doc_id) == sorted(table("documents").doc_id)
        assert (rows.held_out == [zlib.crc32(str(i).encode()) % n == k for i in rows.doc_id]).all()
        assert rows.score.between(0, 1).all()
    tox = results("op6_toxicity")[1]
    assert (tox.predicted == (tox.score >= 0.5)).all()
    lang = results("op5_language_id")[1].merge(table("documents"), on="doc_id")
    assert (lang.lang_pred == lang.lang)[lang.held_out & lang.lang.notna()].mean() > 0.95


def test_pieces_are_the_documents(results):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = results("op7_packing")[1]
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in table("documents").itertuples():
        ids = np.array([*encode.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own = rows[rows.doc_id == r.doc_id].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own.itertuples()] == own.ids_crc32.tolist()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert rows.length.sum() / (rows.sequence_id.nunique() * 2048) > 0.9


def test_neighbours(results):
    rows, emb = results("op8_nearest_neighbours")[1], table("embeddings")
    v = np.array(emb.embedding.tolist(), float)
    norm = np.sqrt((v * v).sum(1))
    hits = 0
    for q, own in rows.groupby("query_id"):
        i = emb.index[emb.vec_id == q][0]
        cos = v @ v[i] / (norm * norm[i])
        cos[i] = -2
        best = emb.vec_id.to_numpy()[np.lexsort((emb.vec_id, -cos))[:5]]
        own = own.sort_values("rank")
        hits += len(set(best) & set(own.vec_id))
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own.score, [cos[emb.index[emb.vec_id == x][0]] for x in own.vec_id], atol=1e-12)
    assert set(rows.query_id) == set(emb.vec_id[emb.vec_id % 50 == 0])
    assert hits / (5 * rows.query_id.nunique()) >= 0.9


def test_pages(results):
    rows = results("op10_html_extraction")[1].merge(table("pages"), on=["page_id", "url"])
    assert len(rows) == len(table("pages")) and (rows.n_chars == rows.text.str.len()).all()
    for r in rows.itertuples():
        title = decoder.unescape(re.search(r"<h1>(.*?)</h1>", r.html, re.S)[1]).split()
        assert r.text.split("\n\n")[0].split() == title and "track(" not in r.text


def test_repeated_sentences(results):
    """Spans by a reading of the rule that keeps whole texts as keys."""
    rows = results("op3_substring_dedup")[1]
    places = defaultdict(set)
    for r in table("documents").itertuples():
        parts, start = [], 0
        text = r.text or ""
        for m in re.finditer(r"(?<=[.!?])\s+|\n\s*", text):
            parts.append(text[start : m.end()])
            start = m.end()
        parts = [p for p in [*parts, text[start:]] if p]
        words = [p.lower().split() for p in parts]
        for i in range(len(words)):
            if len(words[i]) >= 16:
                places[" ".join(words[i])].add((r.doc_id, i, i + 1))
            n = 0
            for j in range(i, len(words)):
                n += len(words[j])
                if n >= 16 and j >= i + 1:
                    places[" ".join(x for w in words[i : j + 1] for x in w)].add((r.doc_id, i, j + 1))
                    break
    # equal content may come with several ends from one start only where an empty sentence is in between: the first start counts
    want = set()
    for found in places.values():
        first = min((d, s) for d, s, _ in found)
        want |= {(d, first[0]) for d, s, _ in found if (d, s) != first}
    assert {(r.doc_id, r.first_doc_id) for r in rows.itertuples()} == want


def test_removed_sentences(results):
    """What op3 says stays of a text: all but the sentences of any run, however long, that an earlier place has."""
    types, rows = results("op3_substring_dedup")
    assert types == {"doc_id": "bigint", "first_doc_id": "bigint", "first_sentence": "int", "end_sentence": "int", "n_spans": "bigint", "kept_chars": "bigint", "kept_sha256": "string"}
    texts, grams = {}, defaultdict(int)
    for r in table("documents").itertuples():
        parts = re.findall(r"(?s).+?(?:(?<=[.!?])\s+|\n\s*|\Z)", r.text or "")
        assert "".join(parts) == (r.text or "") and all(p.strip() for p in parts)
        words = [p.lower().split() for p in parts]
        flat = [w for p in words for w in p]
        texts[r.doc_id] = parts, words
        for g in zip(*(flat[k:] for k in range(16)), strict=False):
            grams[g] += 1
    places = defaultdict(set)
    for d, (parts, words) in texts.items():
        for i in range(len(parts)):
            run = []
            for j in range(i, len(parts)):
                run += words[j]
                if len(run) >= 16:
                    # a run with 16 words in a row that are nowhere else is nowhere else, and no longer one is
                    if any(grams[tuple(run[k : k + 16])] < 2 for k in range(max(0, len(run) - len(words[j]) - 15), len(run) - 15)):
                        break
                    places[" ".join(run)].add((d, i, j + 1))
    gone = defaultdict(set)
    for found in places.values():
        first = min(found)[:2]
        for d, i, j in found:
            if (d, i) != first:
                gone[d] |= set(range(i, j))
    want = {}
    for d, lost in gone.items():
        kept = "".join(p for k, p in enumerate(texts[d][0]) if k not in lost)
        want[d] = (len(kept), hashlib.sha256(kept.encode()).hexdigest())
    assert want and {r.doc_id: (r.kept_chars, r.kept_sha256) for r in rows.itertuples()} == want
    assert all(set(range(r.first_sentence, r.end_sentence)) & gone[r.doc_id] for r in rows.itertuples())


def test_benchmark_passages(results):
    """Documents that hold ten words of an item in a row, by plain search of strings."""
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    docs = {r.doc_id: norm(r.text) for r in table("documents").itertuples()}
    want = set()
    for item in table("benchmark").itertuples():
        w = norm(item.text).split()
        grams = [" " + " ".join(w[i : i + 12]) + " " for i in range(len(w) - 11)]
        want |= {d for d, t in docs.items() if any(g in t for g in grams)}
    assert want and want <= set(results("op4_decontamination")[1].doc_id)


def test_secrets(results):
    rows = results("op2_secret_scan")[1]
    docs = {r.doc_id: r.text for r in table("documents").itertuples()}
    assert all(r.secret in docs[r.doc_id] for r in rows.itertuples()) and rows.probability.between(0.5, 1).all()
    planted = {(d, m[1]) for d, t in docs.items() for m in re.finditer(r"token = \"([0-9a-f]{40})\"", t or "")}
    assert planted <= {(r.doc_id, r.secret) for r in rows.itertuples()}


def test_pipeline_rows(spark, results):
    rows = results("pipeline")[1]
    assert set(rows.doc_id) <= set(table("documents").doc_id)
    assert os.path.exists(SF) and rows.length.sum() == sum(len(x) for x in rows.ids)
