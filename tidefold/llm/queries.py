"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import line_dedup, media, mixing, ngram_join, oracles, packing, quality, secret_scan, sharding, token_files, toxicity
from tidefold.llm.common import read_documents, read_table, written


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read_documents(spark, sf_dir).select("doc_id", "source", "text"))
    first = F.get("positions", F.lit(0)).alias("position")
    out = written(out.select("doc_id", "size", "source_size", "target", "taken", first), "mix")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.examine(media.store(read_documents(spark, sf_dir).select("doc_id", "text")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir).select("doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read_documents(spark, sf_dir).select("doc_id", "text"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_documents(spark, sf_dir).select("doc_id", "text"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_documents(spark, sf_dir).select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(read_documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read_documents(spark, sf_dir).select("doc_id", "text", "lang"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(read_documents(spark, sf_dir).select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_mixing": op2_mixing,
        "op3_media": op3_media,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_secret_scan": op6_secret_scan,
        "op7_token_files": op7_token_files,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_ngram_join": op10_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": oracles.LINE_DEDUP, "op2_mixing": oracles.MIXING, "op5_sharding": oracles.SHARDING}
