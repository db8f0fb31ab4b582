"""Pushes to repositories, and the incremental refresh that they start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clone_url, pushed_to_default
from ..schemas import PUSH


def pushes(events: DataFrame, repos: DataFrame, payload: str = "payload") -> DataFrame:
    """(repo_id, url) of ready-made repositories that an event (JSON text) pushes to the default branch of; malformed events match none."""
    read = events.withColumn("_push", F.from_json(payload, PUSH)).where(pushed_to_default(F.col("_push")))
    own = repos.withColumn("_url", clone_url(F.col("url")))
    return read.withColumn("_url", clone_url(F.col("_push.repository.clone_url"))).join(own, "_url").drop("_url", "_push")


def refresh_on_push(events: DataFrame, repos: DataFrame, refresh: Callable[[list[str]], None], checkpoint: str):
    """Starts a query that calls refresh with the repo_ids of each batch."""

    def each(batch: DataFrame, _: int) -> None:
        found = sorted(r.repo_id for r in pushes(batch, repos).select("repo_id").distinct().collect())  # a batch's repositories
        if found:
            refresh(found)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
