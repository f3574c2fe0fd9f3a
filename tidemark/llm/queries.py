"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.oracle import ORACLE


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import urls

    return urls.judge(_read(spark, sf_dir, "pages"))


def op3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import conversations

    return conversations.in_reply_order(_read(spark, sf_dir, "conversations"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import mixing

    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import quality

    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _read(spark, sf_dir, "labels")))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import store, tokens

    return tokens.shard_files(_read(spark, sf_dir, "documents"), store.new_path(spark, "shards"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import decontaminate

    return decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import sharding

    return sharding.assign(_read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import rules

    out, _ = rules.judge(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import minhash

    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import substring

    return substring.remove(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_url_filters,
    op2_minhash,
    op3_conversations,
    op4_mixing,
    op5_quality_classifier,
    op6_token_shards,
    op7_quality_rules,
    op8_decontamination,
    op9_sharding,
    op10_substring_dedup,
)}

ORACLE_SQL: dict[str, str] = ORACLE
