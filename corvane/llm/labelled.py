"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids are in fold 0."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(folds)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(_id, _label, _text) of ``per_class`` rows at most of each label, without the held-out fold; how many rows each label has there.

    The rows of each label are those of the least hashes of their ids, so that the sample is the
    same however the tables are dealt out. Rows whose id or label is null are left out; an id with
    both labels counts for each; of several texts of an id the least one is taken.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1)).withColumn("_id2", F.col("_id"))
    known = known.where(fold("_id2", folds) != held_out).select("_id", "_label").distinct()
    counts = {int(k): int(n) for k, n in known.groupBy("_label").count().collect()}
    parts = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(parts[0].unionByName(parts[1])), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")), counts
