"""Changes between two versions of a table, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str = "file_path", digest: str = "digest") -> DataFrame:
    """(key, change): added, changed or deleted; a renamed file is deleted and added."""
    a = old.select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(F.col(key), F.col(digest).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def merge(existing: DataFrame, replaced: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """What exists without the replaced keys, and what is fresh; the column ``generation`` (0, 1) keeps their order."""
    kept = existing.join(replaced.select(*key).distinct(), key, "left_anti")
    return kept.withColumn("generation", F.lit(0)).unionByName(fresh.withColumn("generation", F.lit(1)))


def upsert_repos(repos: DataFrame, urls: DataFrame) -> DataFrame:
    """The repository table after requests to add urls (repo_id, url): failed ones start anew, known ones stay, new ones are pending."""
    asked = urls.groupBy("url").agg(F.min("repo_id").alias("_new_id"))
    both = repos.join(asked, "url", "full_outer")
    again = F.col("_new_id").isNotNull() & (F.col("status") == "error")
    status = F.when(F.col("repo_id").isNull() | again, "pending").otherwise(F.col("status"))
    sha = F.when(~F.coalesce(again, F.lit(False)), F.col("last_commit_sha"))
    return both.select(F.coalesce("repo_id", "_new_id").alias("repo_id"), "url", status.alias("status"), sha.alias("last_commit_sha"), "indexed_at", "created_at")
