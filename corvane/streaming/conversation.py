"""Conversations and answers that arrive bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.decode import decoded_further
from ..sources.tables import Store

# Turns that a conversation keeps, and seconds that it is remembered.
KEPT, LIVE = 6, 3600
#: Parts of the histories' table.
SESSION_PARTS = 64
HISTORY = "session_id string, turn long, role string, text string, at timestamp"


def last_turns(history: DataFrame, session: str = "session_id", turn: str = "turn", keep: int = KEPT) -> DataFrame:
    """The most recent turns of each session, oldest first by column position (from 1)."""
    newest = history.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.col(turn).desc()))).where(F.col("_n") <= keep)
    return newest.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(turn))).drop("_n")


def deltas(tokens: DataFrame) -> DataFrame:
    """Batch form of (request_id, seq, token): the text up to and with each token, and its length before it (column length: what was there already).

    The whole text is made once a request; each row takes its prefix of it.
    """
    before = Window.partitionBy("request_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.withColumn("length", F.coalesce(F.sum(F.length("token")).over(before), F.lit(0)))
    whole = tokens.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), "").alias("whole"))
    return placed.join(whole, "request_id").withColumn("text", F.substring("whole", F.lit(1), (F.col("length") + F.length("token")).cast("int"))).drop("whole")


def streamed_deltas(tokens: DataFrame, live: int | None = LIVE) -> DataFrame:
    """A stream of (request_id, seq, token) as (request_id, seq, delta): new characters of the decoded answer; tokens of a batch are taken in order of seq.

    The state is what isn't decoded yet, a few characters once the answer has begun, so that each
    token is decoded once. It is dropped when a request has been silent for ``live`` seconds
    (None: never, for queries that end).
    """

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rest, begun, ended = state.get if state.exists else ("", False, False)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if ended:
                break
            new, rest, begun, ended = decoded_further(rest + row.token, begun)
            if new:
                out.append((key[0], int(row.seq), new))
        state.update((rest, begun, ended))
        if live:
            state.setTimeoutDuration(live * 1000)
        yield pd.DataFrame(out, columns=["request_id", "seq", "delta"])

    return tokens.groupBy("request_id").applyInPandasWithState(grow, "request_id string, seq long, delta string", "rest string, begun boolean, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.NoTimeout)


def remember(turns: DataFrame, store: Store, checkpoint: str):
    """Starts a query that appends a stream of (session_id, turn, role, text) to the sessions' histories: the last KEPT turns of each stay, for an hour after the last one.

    The store has a part for each of SESSION_PARTS groups of sessions, so a batch rewrites only
    the parts that it touches.
    """

    def each(batch: DataFrame, _: int) -> None:
        part = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_PARTS)).cast("string")
        rows = batch.select("session_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.current_timestamp().alias("at")).withColumn("part", part).persist()
        base, changes = store.version(), {}
        for name in sorted(r.part for r in rows.select("part").distinct().collect()):  # SESSION_PARTS at most
            both = store.read("history", HISTORY, [name]).unionByName(rows.where(F.col("part") == name).drop("part")) if name in store.state().get("history", {}) else rows.where(F.col("part") == name).drop("part")
            newest = both.dropDuplicates(["session_id", "turn"]).withColumn("_last", F.max("at").over(Window.partitionBy("session_id")))
            alive = newest.where(F.col("_last") > F.current_timestamp() - F.expr(f"INTERVAL {LIVE} SECONDS")).drop("_last")
            changes["history", name] = last_turns(alive).drop("position")
        if changes:
            store.commit(changes, base)
        rows.unpersist()

    return turns.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def history(store: Store) -> DataFrame:
    """(session_id, turn, role, text, at) of the sessions that are still remembered."""
    rows = store.read("history", HISTORY)
    live = rows.groupBy("session_id").agg(F.max("at").alias("last")).where(F.col("last") > F.current_timestamp() - F.expr(f"INTERVAL {LIVE} SECONDS"))
    return rows.join(live.select("session_id"), "session_id", "left_semi")
