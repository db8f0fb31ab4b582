"""Arrow batches in runs of bounded size, and the best rows of each query among candidates."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a list column (or bytes of a text column) in a run of rows, and its rows, at most; a longer row is a run of its own.
RUN, RUN_ROWS = 1 << 20, 2048


@lru_cache(maxsize=1)
def _c_library() -> ctypes.CDLL | None:
    try:
        own = ctypes.CDLL(None)
        return own if hasattr(own, "malloc_trim") else None
    except OSError:
        return None


def give_back() -> None:
    """Hands memory that this worker has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _c_library() is not None:
        _c_library().malloc_trim(0)


def runs(batches: Iterator[pa.RecordBatch], column: int, most: int = RUN, rows: int = RUN_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``most`` entries of a list column, or bytes of a text column."""
    for batch in batches:
        own = batch.column(column)
        sizes = pc.list_value_length(own) if pa.types.is_list(own.type) else pc.binary_length(own)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            base = ends[first - 1] if first else 0
            last = max(first + 1, min(first + rows, int(np.searchsorted(ends, base + most, "right"))))
            yield batch.slice(first, last - first)
            first = last
    give_back()


def places(ids: pa.Array) -> np.ndarray:
    """Each id's place in their order, equal ones the same, null last."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


class Best:
    """The k best (score, id) of each of n queries among the rows that were added: by score as rounded to 6 places, then by id."""

    def __init__(self, n: int, k: int, above: float = -np.inf):
        self.k, self.above = k, above
        self.floor = np.full(n, -np.inf)
        self.held: tuple[np.ndarray, np.ndarray, pa.Array] | None = None

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """scores: of the queries from ``first`` on, a row each, and of the ids, a column each."""
        rounded, floor = np.round(scores, 6), self.floor[first : first + len(scores), None]
        good = (rounded >= floor) & (rounded > self.above)
        if np.count_nonzero(good) > 4 * self.k * len(scores):
            good &= rounded >= np.partition(rounded, -min(self.k, rounded.shape[1]), 1)[:, -min(self.k, rounded.shape[1]), None]
        q, column = np.nonzero(good)
        if not len(q):
            return
        query, score, own = q + first, scores[q, column], ids.take(pa.array(column))
        if self.held is not None:
            inside = (self.held[0] >= first) & (self.held[0] < first + len(scores))
            apart = self.held[0][~inside], self.held[1][~inside], self.held[2].filter(pa.array(~inside))
            query, score, own = np.concatenate([self.held[0][inside], query]), np.concatenate([self.held[1][inside], score]), pa.concat_arrays([self.held[2].filter(pa.array(inside)), own])
        else:
            apart = None
        shown = np.round(score, 6)
        order = np.lexsort((places(own), -shown, query))
        query = query[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        last = nth == self.k - 1
        self.floor[query[last]] = shown[order[last]]
        keep = nth < self.k
        query, score, own = query[keep], score[order[keep]], own.take(pa.array(order[keep]))
        self.held = (query, score, own) if apart is None else (np.concatenate([apart[0], query]), np.concatenate([apart[1], score]), pa.concat_arrays([apart[2], own]))
