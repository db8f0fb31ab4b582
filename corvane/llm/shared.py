"""Scratch tables in the cluster's shared folder, and ranks without hot tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import kept, shared_dir, small_batches

def scratch_dir(spark: SparkSession) -> str:
    """The name of a new folder in the folder that the cluster's machines share."""
    small_batches(spark)
    return f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    return kept(df)


#: Keys that are joined by sending them to all tasks, at most.
HOT_KEYS = 100_000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key; a key of more than total / HOT_KEYS rows goes to all tasks.

    count: right's column with the number of left's rows that have the key, ``total`` in all, so
    that HOT_KEYS keys at most are sent to all tasks and any other is a small share of a shuffle.
    """
    hot = F.broadcast(right.where(F.col(count) * HOT_KEYS > total))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(hot, key, how).unionByName(rest.join(right.where(F.col(count) * HOT_KEYS <= total), key, how))


def rank_in_group(df: DataFrame, group: list[str], order: list[str], salts: int, name: str = "rank") -> DataFrame:
    """Adds a gapless 0-based rank within each group, whose rows are dealt to ``salts`` cells.

    A group of any size is numbered by up to ``salts`` tasks: rows get a number within their
    cell (group, hash of the order columns), and cells start where the earlier cells of their
    group end. Only cell sizes (groups x salts rows at most) meet in a window over the group.
    Rows with equal group and order columns are numbered among themselves arbitrarily.
    """
    cell: Column = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)).cast("int")
    dealt = df.withColumn("_cell", cell)
    sizes = dealt.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order)) - 1
    numbered = dealt.withColumn("_within", within)
    return numbered.join(starts, [*group, "_cell"]).withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_cell", "_start", "_within")
