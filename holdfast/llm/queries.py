"""Registered queries of the numbered operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from holdfast.llm import (
    html_text, language_id, licenses, line_dedup, near_dedup, packing, pieces, quality_rules, source_audit, suffix_dedup, top_k, toxicity,
    vector_codes,
)
from holdfast.llm.sql import OP3, OP7, OP8, OP9, OP11, OP12, OP13
from holdfast.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every text's ids, and whether decoding them returns the text."""
    return pieces.digest(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECE_BPE)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, language_id.fit(docs))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per license passage found in a document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_toxicity, op3_suffix_dedup, op4_html_text, op5_sentencepiece, op6_language_id, op7_exact_top_k,
        op8_quality_rules, op9_minhash_near_dedup, op10_license_scan, op11_line_dedup, op12_vector_codes, op13_source_divergence,
    )}


def llm_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": OP3, "op7_exact_top_k": OP7, "op8_quality_rules": OP8, "op9_minhash_near_dedup": OP9,
        "op11_line_dedup": OP11, "op12_vector_codes": OP12, "op13_source_divergence": OP13,
    }
