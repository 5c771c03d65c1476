"""From raw documents to packed sequences: five stages, each over all that the one before kept.

All but the last return the columns of `documents`. Only the last changes shape:
one row per piece of a document in a sequence, with its token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, langid, lines, minhash, packing
from cellweave.llm.common import Scratch, table
from cellweave.llm.queries import tokenizer_args

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language: those without a letter go, and those that resemble none (other scripts, letters at random, codes)."""
    net = langid.fit(docs, F.lit(True))
    told = langid.predict(docs.select(*COLUMNS), net)
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_other") < net.bound)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document has; every document stays."""
    done = lines.dedup_lines(docs.select(*COLUMNS))
    return done.withColumns({"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, 0.8)."""
    return minhash.keep_one(docs.select(*COLUMNS), minhash.Scheme())


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, **tokenizer_args(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: A trained network decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder before the next begins, and goes after that."""
    docs, keep, last = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = keep.cut(stage(spark, docs, sf_dir), name)
        if last is not None:
            keep.free(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
