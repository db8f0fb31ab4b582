"""The corpus pipeline: from raw documents to packed training sequences, stage by stage.

Every stage but the last returns the columns of documents. Null ids and extra columns are carried
as they are, repeated rows count each, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import longrepeats, neardup, packing, quality_rules, toxicity
from corvane.llm.shared import saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't mark as toxic. Null, empty and wordless texts get the share of label 1 among such examples."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts, and those of fewer than ten words, go. Whole texts are judged, however long."""
    return quality_rules.rate(docs).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: of the least id that isn't null, then of the least digest; null texts are like empty ones, which are one class."""
    return neardup.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that repeat, whole characters at a time; n_chars follows the text. Null texts stay null, and a text that repeats as a whole is empty afterwards."""
    return longrepeats.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 4096; an empty or null text is its end id alone, longer ones are cut."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_good), ("near_duplicates", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: Tokenizers and samplers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
