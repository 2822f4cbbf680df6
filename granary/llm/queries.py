"""Queries opN_<name>: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontam, html, jaccard, lmscore, mixing, oracles, pii, quality, sharding, substring, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op2_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))[0]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), 40)[0]


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring.digested(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.judge(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(spark, tokens.write_tokens(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_lmscore, op3_jaccard, op4_sharding, op5_html, op6_decontam, op7_pii, op8_substring, op9_quality, op10_tokens)}


def oracle_sql() -> dict[str, str]:
    """The other queries use models, checksums, edit distances, tokenizers or parsers that DuckDB doesn't have; tests hold them
    against brute-force versions."""
    return {"op3_jaccard": oracles.JACCARD, "op8_substring": oracles.SUBSTRING, "op9_quality": oracles.QUALITY}
