"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, lines, mixing, ngrams, quality, search, secrets, sharding, vectors
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> tuple[str, str]:
    """The rank file and the pattern of the public multilingual byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_report(table(spark, sf_dir, "documents"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.digest(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op7_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs).drop("mix_source", "n_chars")


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_crf": op3_quality_crf,
    "op4_bm25_top_k": op4_bm25_top_k,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_preferences": op6_chat_preferences,
    "op7_resharding": op7_resharding,
    "op8_vector_dedup": op8_vector_dedup,
    "op9_bpe": op9_bpe,
    "op10_pfair_mix": op10_pfair_mix,
}

#: DuckDB SQL where it can express the query on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op6_chat_preferences": chat.ORACLE_SQL,
}
