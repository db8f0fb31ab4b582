"""Text columns of Arrow batches as flat numpy byte arrays, and hashes of their words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..operators.batches import give_back

#: Bytes that separate words: space and the ASCII controls 9 to 13.
SEPARATES = np.zeros(256, bool)
SEPARATES[[32, 9, 10, 11, 12, 13]] = True
#: An odd multiplier, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def plain(array: pa.Array) -> pa.Array:
    """A text or binary array without nulls (null: empty) and without a slice offset."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        array = array.cast(pa.string() if pa.types.is_large_string(array.type) else pa.binary())
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_string(array.type) else b"")
    return array


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array one after another, and where each text starts (and the end)."""
    array = plain(array)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``most`` bytes of text; a longer text is a run of its own. text: the column of texts, or of their sizes."""
    for batch in batches:
        own = column(batch, text)
        sizes = pc.fill_null(own if pa.types.is_integer(own.type) else pc.binary_length(own), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        first = 0
        while first < len(ends):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(first, last - first)
            first = last
    give_back()


_held: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; a worker holds one table, as long as it has needed."""
    if not _held or len(_held[0]) < n:
        _held.clear()
        for x in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(max(n, 1 << 20), x, np.uint64)
            table[0] = 1
            _held.append(np.cumprod(table, out=table))
    return _held[0][:n], _held[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of data[start:end]."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word (run of bytes that do not separate)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SEPARATES[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of ``size`` words; a text of fewer words is one shingle of all of them, one without words has none."""
    starts, ends, doc = words(data, offsets)
    hashed = span_hashes(data, starts, ends)
    n, docs = len(hashed), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.bincount(doc, minlength=docs)
    first = np.zeros(docs, np.int64)
    np.cumsum(count[:-1], out=first[1:])
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out[: n - k] += hashed[k:] * np.uint64(pow(BASE, 2 * k + 1, 1 << 64))
    left = first[doc] + count[doc] - np.arange(n)
    whole = left >= size
    short = np.flatnonzero((count > 0) & (count < size))
    for d in short:
        value = sum(int(h) * pow(BASE, 2 * k + 1, 1 << 64) for k, h in enumerate(hashed[first[d] : first[d] + count[d]])) & MASK
        out[first[d]], whole[first[d]] = value, True
    return mix(out[whole]), doc[whole]


def codepoints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after another, and where each text's begin (and the end). Bytes that aren't UTF-8 become U+FFFD."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return points, before[offsets]
    except UnicodeDecodeError:
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points below 2**16: whether it is a letter, and its lower case (itself where that isn't one code point)."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(1 << 16)]
    lower = np.array([ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in chars], np.uint32)
    return np.array([x.isalpha() for x in chars]), lower


def letter_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of letters, in lower case. Letters beyond 2**16 are taken as they are."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    is_letter, lower = letter_tables()
    near = np.minimum(points, 0xFFFF)
    inside = is_letter[near] | (points > 0xFFFF)
    folded = np.where(points > 0xFFFF, points, lower[near])
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return span_hashes(folded, starts, ends), np.searchsorted(offsets, starts, "right") - 1
