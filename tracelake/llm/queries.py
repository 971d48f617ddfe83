"""The registered queries of the corpus operators, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, language_id, line_dedup, merkle, ngram_join, oracles, privacy, quality, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_predictions(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.history(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(_table(spark, sf_dir, "documents"), exact_short=True)


def op7_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digests(_table(spark, sf_dir, "documents"))


def op7_privacy_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 without the hard support, whose SQL op7_privacy has to match."""
    return privacy.digests(_table(spark, sf_dir, "documents"), smoothing=privacy.SMOOTHING)


def op7_privacy_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 with every word of a text as a mention's context; op7_privacy's SQL has a window."""
    return privacy.digests(_table(spark, sf_dir, "documents"), whole=True)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(chat.HOSTILE, "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted_turns(rows))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.phrase_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's proximity matches, a query of their own because op10_decontamination's SQL fixes its columns."""
    return decontamination.proximity_digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_QUERIES = (op1_language_id, op2_bpe, op3_token_counts, op4_ngram_join, op5_fingerprints, op6_line_dedup, op7_privacy, op7_privacy_smoothed, op7_privacy_whole, op8_chat_formatting, op9_quality, op10_decontamination, op10_proximity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_token_counts": token_counts.ORACLE, "op5_fingerprints": merkle.ORACLE, **oracles.ORACLES}
