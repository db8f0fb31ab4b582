"""Progress of index jobs: snapshots, throttling and streams that end with their job."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import FINAL_PHASES, percent
from ..sources.tables import Conflict, Store

# Fixed value: seconds that a snapshot is replayed for.
LIVE = 3600


def with_percent(events: DataFrame) -> DataFrame:
    return events.withColumn("percent", percent(F.col("phase"), F.col("current"), F.col("total")))


def latest(events: DataFrame, key: str = "repo_id", order: str = "ts") -> DataFrame:
    """The last event of each key; for a stream, in update or complete mode."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(key, "last.*")


def throttled(events: DataFrame, key: str, order: str, parts: int = 50) -> DataFrame:
    """Every max(1, n // parts)-th event of each key, and its last."""
    w = Window.partitionBy(key)
    numbered = events.withColumn("rn", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.expr(f"n div {parts}"))
    return numbered.where((F.col("rn") % step == 0) | (F.col("rn") == F.col("n")))


def replayed(events: DataFrame, since: int, live: int = LIVE * 1_000_000) -> DataFrame:
    """What a subscriber that joins at time ``since`` sees of events (repo_id, phase, percent, ts): first the last event before that, if it isn't older than ``live``, then what follows, each once, none after the first final one."""
    once = events.dropDuplicates(["repo_id", "ts"])
    by_time = Window.partitionBy("repo_id").orderBy("ts")
    last = F.max(F.when(F.col("ts") <= since, F.col("ts"))).over(Window.partitionBy("repo_id"))
    seen = once.withColumn("_last", last).where((F.col("ts") > since) | ((F.col("ts") == F.col("_last")) & (F.col("ts") >= since - live))).drop("_last")
    ended = F.max(F.col("phase").isin(*sorted(FINAL_PHASES))).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    return seen.withColumn("_ended", F.coalesce(ended, F.lit(False))).where(~F.col("_ended")).drop("_ended")


def followed(events: DataFrame, since: int | None = None, live: int | None = LIVE) -> DataFrame:
    """A stream's events (repo_id, phase, percent, ts in microseconds) as a subscriber sees them: each once, in order of time within a batch, none after the final one.

    since: when the subscriber joined; of a first batch's events up to then only the last one is
    sent, the snapshot, if it isn't older than LIVE seconds. A repository's state is dropped when
    it has been silent for ``live`` seconds (None: never, for queries that end).
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, ended = state.get if state.exists else (-1, False)
        rows = pd.concat(list(frames)).drop_duplicates("ts").sort_values("ts")
        rows = rows[rows.ts > last]
        if since is not None:
            snapshot = rows[(rows.ts <= since) & (rows.ts >= since - LIVE * 1_000_000)].tail(0 if state.exists else 1)
            rows = pd.concat([snapshot, rows[rows.ts > since]])
        if ended or rows.empty:
            rows = rows.iloc[:0]
        else:
            final = rows.phase.isin(FINAL_PHASES)
            if final.any():
                rows, ended = rows.iloc[: int(final.to_numpy().argmax()) + 1], True
            last = int(rows.ts.iloc[-1])
        state.update((last, ended))
        if live:
            state.setTimeoutDuration(live * 1000)
        yield rows.assign(repo_id=key[0])[["repo_id", "phase", "percent", "ts"]]

    return events.groupBy("repo_id").applyInPandasWithState(follow, "repo_id string, phase string, percent int, ts long", "last long, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.NoTimeout)


def publish(events: DataFrame, store: Store, checkpoint: str, event_time: str = "ts"):
    """Starts a query that keeps the snapshot of each repository of a stream of events: the last event, in the store's table ``progress``. A batch that cannot be written is left out; telling must not break what is told of."""
    schema = events.schema

    def each(batch: DataFrame, _: int) -> None:
        try:
            base = store.version()
            both = store.read("progress", schema).unionByName(batch)
            store.commit({("progress", ""): latest(both, "repo_id", event_time).select(*schema.names)}, base)
        except Conflict:
            pass

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
