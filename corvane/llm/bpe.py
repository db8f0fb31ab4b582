"""Byte-level BPE by rounds over padded matrices of pieces."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column, slices
from .tokens import Encoder, gather

NONE = np.int32(np.iinfo(np.int32).max)
#: Widths of the padded matrices; a longer piece merges by a heap, pair by pair in the same order.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512)
#: Rows of a matrix.
ROWS = 8192


class Pairs:
    """An open-addressing hash table of id pairs: pair -> id of the merged token (which is its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits, self.single = max(4, int(4 * len(left)).bit_length()), None
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key, value, self.probes = (left.astype(np.int64) << 32) | right, merged.astype(np.int32), 0
        slot = self._slot(key)
        while len(key):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            own = free & (self.keys[slot] == key)
            self.values[slot[own]] = value[own]
            key, value, slot = key[~own], value[~own], (slot[~own] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def table(self) -> dict[int, int]:
        """The same as a dictionary, made on first use: for one pair at a time."""
        if self.single is None:
            own = self.keys != -1
            self.single = dict(zip(self.keys[own].tolist(), self.values[own].tolist()))
        return self.single

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; NONE where the pair has none or an id is -1."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], NONE)
        rest = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.values[slot[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return np.where((left < 0) | (right < 0), NONE, out)


class ByteBpe:
    """Encodes and decodes by a file of ranks, as byte-pair merging by lowest rank does."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        names = [b""] * size
        for name, rank in self.ranks.items():
            names[rank] = name
        self.name_count = np.array([len(x) for x in names], np.int64)
        self.name_begin = np.cumsum(self.name_count) - self.name_count
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        get = self.ranks.get
        found = [(a, b, rank) for name, rank in self.ranks.items() for k in range(1, len(name)) if (a := get(name[:k])) is not None and (b := get(name[k:])) is not None]
        self.pairs = Pairs(*np.array(found or np.zeros((0, 3)), np.int64).T)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, and how many each has: the pattern's matches are merged separately, each distinct one once."""
        found = [self.pattern.findall(t) for t in texts]
        flat = [p for x in found for p in x]
        where = {p: i for i, p in enumerate(dict.fromkeys(flat))}
        ids, count = self.merge([p.encode() for p in where])
        use = np.fromiter(map(where.__getitem__, flat), np.int64, len(flat))
        begin = (np.cumsum(count) - count)[use] if len(flat) else use
        used = count[use] if len(flat) else use
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        return gather(ids, begin, used), np.bincount(doc, used, len(texts)).astype(np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, and how many each has."""
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = np.searchsorted(WIDTHS, lengths)
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                parts[i] = np.array([whole], np.int32)
            elif piece:
                buckets.setdefault(int(widths[i]), []).append(i)
        for width, own in buckets.items():
            if width == len(WIDTHS):
                for i in own:
                    parts[i] = self._merge_long(pieces[i])
                continue
            for k in range(0, len(own), ROWS):
                rows = own[k : k + ROWS]
                ids, count = self._merge_matrix([pieces[i] for i in rows], WIDTHS[width])
                for i, row, n in zip(rows, ids, count):
                    parts[i] = row[:n]
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.fromiter(map(len, parts), np.int64, len(parts))

    def _merge_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Every round, every row merges its leftmost pair of minimum rank; rows without one leave."""
        count = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < count[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        out, row = ids.copy(), np.arange(len(pieces))
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        while len(row):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(row)), at]
            going = best != NONE
            if not going.all():
                out[row[~going], : ids.shape[1]] = ids[~going]
                ids, ranks, row, at, best = ids[going], ranks[going], row[going], at[going], best[going]
                if not len(row):
                    break
            count[row] -= 1
            every = np.arange(len(row))
            ids[every, at] = best
            if ids.shape[1] == 2:  # the pair was all there was
                out[row, 0] = ids[:, 0]
                break
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns <= at[:, None], ids[:, :-1], ids[:, 1:])
            ranks = np.where(columns[:-1] <= at[:, None], ranks[:, :-1], ranks[:, 1:])
            inner = at < ids.shape[1] - 1
            r, c = every[inner], at[inner]
            ranks[r, c] = self.pairs(ids[r, c], ids[r, c + 1])
            inner = at > 0
            r, c = every[inner], at[inner]
            ranks[r, c - 1] = self.pairs(ids[r, c - 1], ids[r, c])
        return out, count

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order, by a heap of (rank, place) and a linked list."""
        known = self.pairs.table()
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        here, after, before = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(int(r), i, i + 1) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        state = dict(enumerate(first.tolist()))
        none = int(NONE)

        def pair(i: int) -> None:
            j = after[i]
            state[i] = rank = known.get((here[i] << 32) | here[j], none) if j < len(here) else none
            if rank != none:
                heapq.heappush(heap, (rank, i, j))

        while heap:
            rank, i, j = heapq.heappop(heap)
            if here[i] < 0 or state[i] != rank or after[i] != j:
                continue
            here[i], after[i] = rank, after[j]
            here[j] = -1
            if after[j] < len(here):
                before[after[j]] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        return np.array([x for x in here if x >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.names, self.name_begin[ids], self.name_count[ids])


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> tuple[ByteBpe, Encoder]:
    bpe = ByteBpe(path, pattern)
    return bpe, Encoder(bpe.pieces, spaced=True)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_tokens, sha256 of the ids (little-endian unsigned 32-bit) and of the bytes they decode to.

    Null texts count as empty; every row, also of a null or repeated id, gives one row; other
    columns are ignored. ``pattern`` separates at white space, taking one space before a word along.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = byte_bpe(path, pattern)
        for part in slices(batches, "_text"):
            ids, at = encoder(column(part, "_text"))
            decoded = bpe.decode(ids)
            ends = np.concatenate([[0], np.cumsum(bpe.name_count[ids])])[at]
            stored = ids.astype("<u4")
            yield pa.record_batch(
                [
                    column(part, "_id"),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(stored[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:])], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
