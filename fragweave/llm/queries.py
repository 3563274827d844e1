"""The registered queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, codes, lines, mixing, neardup, phrases, quality, resample, sharding, tokens, topk, urls
from .common import read


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.query(spark, read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.query(spark, read(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.query(spark, read(spark, sf_dir, "embeddings"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(spark, read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(spark, read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from 85 % on."""
    return neardup.near_dups(read(spark, sf_dir, "documents"), percent=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(spark, read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.query(spark, read(spark, sf_dir, "pages"))


def op9_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.query(spark, read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.query(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(spark, read(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.query(spark, read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_output, op2_line_dedup, op3_top_k, op4_byte_bpe, op5_sharding, op6_minhash, op7_mixing, op8_url_filter, op9_phrase_fingerprint, op10_quality, op11_resample, op12_chat_format, op13_vector_codes)
}

#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLE: dict[str, str] = {
    "op2_line_dedup": lines.clean_sql("documents"),
    "op3_top_k": topk.brute_sql("embeddings"),
    "op6_minhash": neardup.brute_sql("documents", percent=85),
    "op11_resample": resample.draw_sql("documents", "benchmark"),
    "op12_chat_format": chat.digest_sql("conversations"),
    "op13_vector_codes": codes.codes_sql("embeddings"),
}
