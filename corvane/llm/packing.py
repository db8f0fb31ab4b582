"""Packing documents into fixed-length sequences by fitted length patterns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import column, slices
from .shared import rank_in_group, saved
from .tokens import library_encoder

#: Bins of the length histogram that patterns are made of.
BINS = 64
#: Most documents of a pattern.
PARTS = 5
#: Share of the fitted repeats that is packed by pattern; the rest serves to close the gaps.
BY_PATTERN = 0.8
#: Pieces of the lowest bins are in no pattern: they close gaps.
GAP_BINS = 4
#: Pieces of one length are numbered by up to this many tasks.
SALTS = 64


@lru_cache(maxsize=4)
def patterns(bins: int, parts: int) -> np.ndarray:
    """Descending bin numbers (1 to bins; 0: none) of up to ``parts`` documents whose mean lengths, the bins' middles, fill a sequence to within half a bin."""
    found: list[tuple[int, ...]] = []

    def grow(own: tuple[int, ...], left: int) -> None:  # left: half bins
        if own and left <= 1:
            found.append(own + (0,) * (parts - len(own)))
        if len(own) < parts:
            for b in range(min((left + 2) // 2, own[-1] if own else bins), 0, -1):
                if (parts - len(own)) * (2 * b - 1) >= left - 1:
                    grow((*own, b), left - 2 * b + 1)

    grow((), 2 * bins)
    return np.array(found, np.int64)


def nnls(matrix: np.ndarray, target: np.ndarray, rounds: int) -> np.ndarray:
    """x >= 0 with least |matrix x - target| (the active-set method of Lawson and Hanson)."""
    n = matrix.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    slope = matrix.T @ target
    near = 1e-9 * max(1.0, np.abs(slope).max(initial=0))
    for _ in range(rounds):
        if active.all() or slope[~active].max(initial=0) <= near:
            break
        active[int(np.where(active, -np.inf, slope).argmax())] = True
        while True:
            own = np.flatnonzero(active)
            trial = np.linalg.lstsq(matrix[:, own], target, rcond=None)[0]
            low = trial <= 0
            if not low.any():
                x[:] = 0
                x[own] = trial
                break
            old = x[own]
            step = np.min(old[low] / np.maximum(old[low] - trial[low], 1e-300))
            x[own] = old + step * (trial - old)
            gone = own[low & (x[own] <= 1e-12)] if (low & (x[own] <= 1e-12)).any() else own[low]
            x[gone], active[gone] = 0, False
            if not active.any():
                break
        slope = matrix.T @ (target - matrix @ x)
    return x


class Plan:
    """Runs of equal sequences. A run's slots are (length, copies): so many pieces of that length, side by side."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.left, self.capacity = histogram.astype(np.int64).copy(), capacity
        self.runs: list[tuple[list[tuple[int, int]], int, int]] = []  # slots, sequences, room left
        self.open: dict[int, list[int]] = {}
        self.gaps = 0  # bit g: a run with room g

    def _put(self, slots: list[tuple[int, int]], count: int, room: int) -> None:
        self.runs.append((slots, count, room))
        if room and count:
            self.open.setdefault(room, []).append(len(self.runs) - 1)
            self.gaps |= 1 << room

    def _largest(self, most: int) -> int:
        """The largest length of at most ``most`` of which pieces are left, or 0."""
        own = np.flatnonzero(self.left[1 : most + 1])
        return int(own[-1]) + 1 if len(own) else 0

    def fill(self, bins: list[int], width: int, repeats: int) -> None:
        """``repeats`` sequences of a pattern: pieces of its bins, the last one the longest that still fits."""
        todo: list[tuple[list[tuple[int, int]], int, int]] = [([], repeats, self.capacity)]
        for k, b in enumerate(bins):
            low, high = (b - 1) * width + 1, min(b * width, self.capacity)
            after = []
            for slots, count, room in todo:
                while count:
                    if k == len(bins) - 1 and k:
                        length = self._largest(room)
                    else:
                        own = np.flatnonzero(self.left[low : min(high, room) + 1])
                        length = int(own[0 if k % 2 else -1]) + low if len(own) else 0
                    if not length:
                        after.append((slots, count, room))
                        break
                    n = min(count, int(self.left[length]))
                    self.left[length] -= n
                    after.append(([*slots, (length, 1)], n, room - length))
                    count -= n
            todo = after
        for slots, count, room in todo:
            if slots:
                self._put(slots, count, room)

    def best_fit(self) -> None:
        """Puts all pieces that are left, the longest first, each where the least room stays."""
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                fits = self.gaps >> length
                if fits:
                    room = length + (fits & -fits).bit_length() - 1
                    slots, count, _ = self.runs[at := self.open[room].pop()]
                    if not self.open[room]:
                        del self.open[room]
                        self.gaps &= ~(1 << room)
                    self.runs[at] = ([], 0, 0)
                else:
                    slots, count, room = [], int(self.left[length]), self.capacity
                copies = min(room // length, int(self.left[length]))
                full = min(count, int(self.left[length]) // copies)
                self.left[length] -= full * copies
                self._put([*slots, (length, copies)], full, room - copies * length)
                rest = count - full
                if rest and self.left[length]:
                    some = int(self.left[length])
                    if some < copies:
                        self.left[length] = 0
                        self._put([*slots, (length, some)], 1, room - some * length)
                        rest -= 1
                if rest and slots:
                    self._put(slots, rest, room)

    def table(self) -> dict[str, np.ndarray]:
        """Per slot: pieces ``rank`` to ``rank + n`` of this length go ``copies`` a sequence from ``sequence`` on, at ``offset``."""
        rows, used, sequence = [], np.zeros(self.capacity + 1, np.int64), 0
        for slots, count, _ in self.runs:
            offset = 0
            for length, copies in slots:
                if count:
                    rows.append((length, used[length], count * copies, copies, sequence, offset))
                    used[length] += count * copies
                    offset += length * copies
            sequence += count
        made = np.array(sorted(rows) or np.zeros((0, 6)), np.int64)
        return dict(zip(("length", "rank", "n", "copies", "sequence", "offset"), made.T))


def plan_packing(histogram: np.ndarray, capacity: int) -> Plan:
    """histogram[l]: pieces of length l. Fits pattern repeats to it, rounds them down and packs the rest by best fit."""
    plan = Plan(histogram, capacity)
    bins = min(BINS, capacity)
    width = -(-capacity // bins)
    bins = capacity // width
    binned = np.zeros(bins + 1)
    lengths = np.arange(1, capacity + 1)
    np.add.at(binned, np.minimum((lengths + width - 1) // width, bins), histogram[1 : capacity + 1])
    own = patterns(bins, PARTS)
    own = own[((binned[own] > 0) | (own == 0)).all(1) & ((own == 0) | (own > GAP_BINS)).all(1)]  # patterns of lengths that there are
    if len(own):
        matrix = np.zeros((bins + 1, len(own)))
        for k in range(PARTS):
            np.add.at(matrix, (own[:, k], np.arange(len(own))), 1.0)
        repeats = nnls(matrix[1:], binned[1:], rounds=6 * bins)
        repeats = np.floor(repeats * BY_PATTERN)
        for i in np.lexsort((np.arange(len(own)), -own[:, 0])):
            if repeats[i] >= 1:
                plan.fill([int(b) for b in own[i] if b], width, int(repeats[i]))
    plan.best_fit()
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each text's ids and end_id, cut after every ``capacity`` ids. Null text: empty."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, False)
        for part in slices(batches, "_text", 6 << 20):
            ids, at = encoder(column(part, "_text"))
            rows, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                whole = np.append(ids[a:b], end_id).astype("<u4")
                for k in range(0, len(whole), capacity):
                    own = whole[k : k + capacity]
                    rows.append(i)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(own))
                    crc.append(zlib.crc32(own))
            yield pa.record_batch([column(part, "_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(cut, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces (columns as of token_pieces); no sequence exceeds ``capacity``.

    The driver holds the histogram of lengths (``capacity`` counts) and the plan: a few runs for
    each length, however many pieces there are. Rows of equal columns are told apart by their rank.
    """
    pieces = saved(pieces)
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        histogram[length] = n
    table = plan_packing(histogram, capacity).table()
    keys = (table["length"] << 44) | table["rank"]
    names = pieces.columns
    ranked = rank_in_group(pieces, ["length"], [id_col, "piece", "ids_crc32"], SALTS)
    schema = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (column(batch, x).to_numpy() for x in ("length", "rank"))
            run = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            turn = rank - table["rank"][run]
            own = [column(batch, x) for x in names]
            sequence, within = np.divmod(turn, table["copies"][run])
            yield pa.record_batch([*own, pa.array(table["sequence"][run] + sequence), pa.array(table["offset"][run] + within * length)], schema.names)

    return ranked.select(*names, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all texts with their sequences.

    Every text gives one piece at least (an empty or null one holds end_id alone); null and
    repeated ids keep their pieces; an empty table gives none; other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity, id_col)
