"""A training corpus from documents, in stages that are each written and read again.

documents need doc_id, text and lang; further columns pass through every stage as they
are, whatever their names (n_chars, if there, is counted anew where a text changes).  Rows
with a null doc_id or any other null stay unless a stage says otherwise; a table without
rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.llm import byte_cnn, circulant_minhash, decontaminate, secret_ledger, soft_mixing
from toposcope.llm._shared import remainder, scratch, stash, table

#: below this posterior no language is recognised
LEAST_SCORE = 0.35


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """What an operator reads, with all other columns out of the way of its results."""
    others = [c for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*others) if others else F.lit(None).cast("string")).alias("__rest"))


def _unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.col("__rest").getField(c).alias(c) for c in names])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language.

    Null texts, empty ones and those without a letter go, as do texts of which no language
    has a posterior of LEAST_SCORE; without labelled rows to learn from all go.  Rows that
    repeat are judged alike.
    """
    own = ("doc_id", "text", *(("lang",) if "lang" in docs.columns else ()))
    found = byte_cnn.identify(_packed(docs, *own), remainder(F.col("doc_id"), 4) != 2)
    kept = found.where((F.col("lang_pred") != byte_cnn.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return _unpacked(kept, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five words, 0.8), and one row of it.

    Texts without words and rows without a doc_id are nobody's copies and stay.
    """
    return circulant_minhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark passages, and documents that hold nothing else.

    Texts without words, and all texts if the benchmark is empty, stay unchanged.
    """
    own = ("doc_id", "text", *(("n_chars",) if "n_chars" in docs.columns else ()))
    return _unpacked(decontaminate.remove_spans(_packed(docs, *own), table(spark, sf_dir, "benchmark")), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; no document goes, and texts without a secret, null ones too, stay as they are."""
    own = ("doc_id", "text", *(("n_chars",) if "n_chars" in docs.columns else ()))
    found = secret_ledger.scan_paths(_packed(docs, *own))
    new = found.withColumn("__text", secret_ledger.redact(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("__text").cast("long")).otherwise(F.col("n_chars")))
    return _unpacked(new.withColumn("text", F.col("__text")).drop("spans", "__text"), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds rates and copies that bring the domains to their target weights.

    The rate is the decision: no row goes or repeats here, `copies` says how often a
    sampler takes it.  Columns of the documents that are named like a result are replaced.
    """
    return soft_mixing.mix(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: the classifiers and the hashed sets have no SQL form; tests hold stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
