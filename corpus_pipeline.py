"""Corpus pipeline: five of the numbered operators, each stage on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from holdfast.llm import language_id, near_dedup, packing, suffix_dedup, toxicity
from holdfast.llm.tables import kept_by_text, store, table

# Learnt decisions and reading of sub-word ids can't be said in SQL; tests compare with brute force instead.
ORACLE_SQL = None
LEAST_LANGUAGE_SCORE = 0.3  # hardly over a guess among four languages


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is hardly more than a guess, go."""
    model = language_id.fit(docs)

    def kept(texts):
        names, scores = language_id.predict_texts(model, texts)
        return pa.array([n != language_id.UNKNOWN and s >= LEAST_LANGUAGE_SCORE for n, s in zip(names, scores)], pa.bool_())

    return kept_by_text(docs, kept)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))

    def kept(texts):
        return pa.array([score < toxicity.THRESHOLD for score in map(model.shared_scorer(), texts)], pa.bool_())

    return kept_by_text(docs, kept)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: of rows with the smallest id, all."""
    kept = near_dedup.near_duplicates(docs, size=5, percent=80).filter("kept").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also lie in a document with a smaller id are cut out; n_chars follows, emptied documents go."""
    cut = suffix_dedup.cleaned(docs).filter(F.col("text") != "")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
