"""The registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html, langid, lines, minhash, packing, secrets, spans, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_args() -> dict:
    """Where the 50k byte-level BPE lies, what splits text and which strings are one id."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": {"<|endoftext|>": 50256}}


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = minhash.near_components(table(spark, sf_dir, "documents"), minhash.Scheme(shingle_words=2, percent=80))
    return done.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), m AS (
  SELECT a, min(b) AS b FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.scan(table(spark, sf_dir, "documents"), secrets.findings_table(spark))
    return done.select("doc_id", "position", "secret", "path", F.round("probability", 6).alias("probability"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that loses sentences and document that first has them, with a digest of the text that stays; all other documents stay whole."""
    done = spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), spans_into="spans").where("spans IS NOT NULL")
    told = done.select("doc_id", F.char_length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"), F.explode("spans").alias("span"))
    return told.groupBy("doc_id", F.col("span.first_doc_id").alias("first_doc_id"), "kept_chars", "kept_sha256").agg(
        F.min("span.start").alias("first_sentence"), F.max("span.stop").alias("end_sentence"), F.count("*").alias("n_spans")
    ).select("doc_id", "first_doc_id", "first_sentence", "end_sentence", "n_spans", "kept_chars", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def remainder(column: str, n: int):
    """crc32 of an id's text, modulo n: what the contracts split rows by."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs, remainder("doc_id", 4) != 2)
    done = langid.predict(docs, net, ["doc_id"])
    return done.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    done = toxicity.segment_scores(docs, model, ["doc_id"])
    return done.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), **tokenizer_args())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), told AS (
  SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html.extract(table(spark, sf_dir, "pages"))
    return done.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extraction": op10_html_extraction,
}
SQL: dict[str, str] = {"op1_minhash": OP1_SQL, "op9_line_dedup": OP9_SQL}
