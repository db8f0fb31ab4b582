"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import rank_in_group, saved

#: Atomic groups: texts with the same leading bits of a hash. Equal texts are always together.
GROUP_BITS, FINER_BITS = 16, 10
#: Rows of a shard are numbered by up to this many tasks.
SALTS = 256


def _fits(prefix: np.ndarray, capacity: int, shards: int) -> bool:
    """Greedy check: do ``shards`` runs of at most ``capacity`` cover all groups?"""
    at, last = 0, len(prefix) - 1
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if at >= last:
            return True
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity with which the groups, in order, fit in ``shards`` contiguous shards."""
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low = max(int(sizes.max(initial=0)), -(-int(prefix[-1]) // shards))
    high = low + int(sizes.max(initial=0))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _fits(prefix, middle, shards) else (middle + 1, high)
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin (shards + 1 places): none exceeds the smallest feasible capacity.

    Of the cuts that this capacity allows, each is the one nearest to an even share of what is
    left, so that the other shards stay even when one group alone fills a shard.
    """
    capacity = smallest_capacity(sizes, shards)
    prefix = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    last = len(prefix) - 1
    earliest = np.zeros(shards + 1, np.int64)  # from where the rest still fits
    earliest[shards] = last
    for k in range(shards - 1, -1, -1):
        earliest[k] = np.searchsorted(prefix, prefix[earliest[k + 1]] - capacity, "left")
    cuts = np.zeros(shards + 1, np.int64)
    for k in range(1, shards + 1):
        begin = cuts[k - 1]
        target = prefix[begin] + (prefix[last] - prefix[begin]) / (shards - k + 1)
        at = int(np.searchsorted(prefix, target, "left"))
        if at > begin + 1 and at <= last and target - prefix[at - 1] <= prefix[at] - target:
            at -= 1
        most = int(np.searchsorted(prefix, prefix[begin] + capacity, "right")) - 1
        cuts[k] = min(max(at, earliest[k], begin), most, last)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals every row to a shard by law ``bytes``: sizes near equal, equal texts together.

    Texts are in order of their hash. Atomic groups are ranges of hashes: first 2**GROUP_BITS of
    them, then those at a cut and those of more than a quarter of a shard are parted in
    2**FINER_BITS and the cuts are searched again, so that the driver sees a bounded number of
    sizes whatever the corpus.

    Returns id_col, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot (gapless from 0 in
    each shard) and grown_shard (null: the cuts follow the sizes, so they all move when a shard
    is added). Null texts count as empty; null and repeated ids keep their rows; an empty table
    gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = saved(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - GROUP_BITS - FINER_BITS).cast("long").alias("_key"),
        )
    )
    group = F.shiftright("_key", FINER_BITS).cast("int").alias("_group")
    sizes = np.zeros(1 << GROUP_BITS, np.int64)
    for cell, total in rows.groupBy(group).agg(F.sum("size")).collect():
        sizes[cell] = total
    edges = minimax_cuts(sizes, shards)[1:-1]
    fine = {int(x) for x in (*edges, *(edges - 1), *np.flatnonzero(sizes * 4 * shards > sizes.sum())) if 0 <= x < len(sizes)}
    keys = {int(c) << FINER_BITS: int(n) for c, n in enumerate(sizes) if c not in fine}
    keys |= dict(rows.where(group.isin(sorted(fine))).groupBy("_key").agg(F.sum("size")).collect()) if fine else {}
    begins = sorted(keys)
    ends = [*begins, 1 << (GROUP_BITS + FINER_BITS)]
    cuts = [ends[at] for at in minimax_cuts(np.array([keys[k] for k in begins], np.int64), shards)[1:-1]]
    shard = sum(((F.col("_key") >= int(x)).cast("int") for x in cuts), F.lit(0))
    placed = rows.select("_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"))
    ranked = rank_in_group(placed, ["shard"], ["_id", "text_crc32", "size"], SALTS, "slot")
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
