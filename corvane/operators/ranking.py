"""Top-k, rank fusion and merges of ranked lists. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank within the group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top(df: DataFrame, group: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group; each task keeps k candidates of a group before rows move."""
    return ranked(df, group, order, name).where(F.col(name) <= k)


def fuse(lists: DataFrame, group: list[str], key: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rows (group, list_no, rank, key, ...), rank from 1.

    Every occurrence adds 1 / (k + rank), also a second one in the same list. The record is that
    of the first list (and best rank) that holds the key; ties of fused_score go by that place.
    """
    rest = [c for c in lists.columns if c not in {*group, *key, "list_no", "rank"}]
    place = F.struct("list_no", "rank")
    fused = lists.groupBy(*group, *key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("fused_score"),
        F.min(place).alias("first"),
        *([F.min_by(F.struct(*rest), place).alias("record")] if rest else []),
    )
    kept = fused.select(*group, *key, "fused_score", "first", *([F.col("record.*")] if rest else []))
    return ranked(kept, group, [F.col("fused_score").desc(), F.col("first")], "fused_rank").drop("first")


def merge_prioritized(priority: DataFrame, ordinary: DataFrame, group: list[str], key: list[str], k: int | Column) -> DataFrame:
    """The first k of the priority rows followed by the ordinary ones (both with rank), each key once, where it stands first."""
    both = priority.withColumn("src", F.lit(0)).unionByName(ordinary.withColumn("src", F.lit(1)), allowMissingColumns=True)
    once = top(both, [*group, *key], [F.col("src"), F.col("rank")], 1, "_again").drop("_again")
    return top(once.withColumnRenamed("rank", "_rank"), group, [F.col("src"), F.col("_rank"), *map(F.col, key)], k).drop("_rank")


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Ordered distinct: of the rows of a key the first in the given order."""
    return top(df, key, order, 1, "_n").drop("_n")


def expansions(queries: DataFrame) -> DataFrame:
    """(qid, variant, query) of rows (qid, question, generated: array): the question, then what was generated.

    Generated entries are trimmed, blank and null ones go; of entries that differ in case alone
    the first stays. Null generated (the expander failed) leaves the question.
    """
    from ..functions.text import stripped

    more = F.filter(F.transform(F.coalesce("generated", F.array().cast("array<string>")), stripped), lambda x: x.isNotNull() & (x != ""))
    rows = queries.select("qid", F.posexplode(F.concat(F.array("question"), more)).alias("pos", "query"))
    once = first_of_each(rows.withColumn("_low", F.lower("query")), ["qid", "_low"], [F.col("pos")])
    return ranked(once, ["qid"], [F.col("pos")], "variant").select("qid", (F.col("variant") - 1).alias("variant"), "query")
