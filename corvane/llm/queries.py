"""The queries of this package: name -> function of (spark, sf_dir), and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, longrepeats, media, neardup, packing, planes, quality_rules, sharding, toxicity
from .shared import small_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.rate(documents(spark, sf_dir).select("doc_id", "text"), columns=["doc_id"])
    return rated.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(documents(spark, sf_dir), tail=32)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=40)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", folds=5, held_out=0)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.token_output(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longrepeats.remove_repeats(documents(spark, sf_dir), length=200)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", folds=3, held_out=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_media_columns": op2_media_columns,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_token_output": op6_token_output,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_minhash": op8_minhash,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLES: dict[str, str] = {"op1_quality_rules": quality_rules.oracle()}
