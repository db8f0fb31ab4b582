"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of an edge: the label is the least node of its component.

    Each round every node takes the least label among itself and its neighbours, then its
    label's label. Tables are written to the shared folder between rounds; the driver sees the
    number of changes only.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    both = saved(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = saved(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        around = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        near = labels.join(around, F.col("node") == F.col("u")).select("node", F.least("label", "near").alias("low"), "label")
        heads = labels.select(F.col("node").alias("head"), F.col("label").alias("over"))
        after = saved(near.join(heads, F.col("low") == F.col("head")).select("node", F.least("low", "over").alias("label"), F.col("label").alias("was")))
        if after.where(F.col("label") != F.col("was")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
