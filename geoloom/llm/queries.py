"""One query for each training-data operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import ann, balls, bpe, langid, linededup, mixing, pii, quality, quotes, runs, simhash, substring, toxicity
from geoloom.llm._common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the setting spark.pii.key; where it is unset, one is drawn that nobody knows, so other runs give other
    surrogates.
    """
    key = spark.conf.get("spark.pii.key", None) or secrets.token_hex(32)
    return pii.anonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key, counts=True)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(table(spark, sf_dir, "conversations"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.ball_kmeans(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_documents(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": linededup.ORACLE_SQL, "op10_chat_quotes": quotes.ORACLE_SQL, "op11_ball_kmeans": balls.ORACLE_SQL}
