"""Results and vectors that are kept for a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import providers

# Seconds that results and query vectors live.
RESULTS_LIVE, VECTORS_LIVE = 3600, 86_400


def query_vectors(queries: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Vectors of (qid, query) and the new entries for the cache (digest, vector, expires_at); only texts without a live entry are embedded."""
    keyed = queries.select("qid", "query", F.sha2("query", 256).alias("digest"))
    held = cache.where(F.col("expires_at") > now).select("digest", "vector")
    missing = keyed.select("digest", "query").dropDuplicates(["digest"]).join(held, "digest", "left_anti").withColumn("row", F.xxhash64("digest"))
    made = providers.embed(missing, "row", F.col("query")).join(missing.select("row", "digest"), "row").select("digest", "vector")
    fresh = made.withColumn("expires_at", now + F.expr(f"INTERVAL {VECTORS_LIVE} SECONDS"))
    return keyed.join(held.unionByName(made), "digest").select("qid", "vector"), fresh


def expiring(results: DataFrame, now: Column, seconds: int = RESULTS_LIVE) -> DataFrame:
    return results.withColumn("expires_at", now + F.expr(f"INTERVAL {seconds} SECONDS"))


def invalidated(cache: DataFrame, repo_id: str) -> tuple[DataFrame, int]:
    """The cache without a repository's entries, and how many those were."""
    gone = cache.where(F.col("repo_id") == repo_id).count()
    return cache.where(~F.col("repo_id").eqNullSafe(F.lit(repo_id))), gone
