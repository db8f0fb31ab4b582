"""Media columns: ISO base media containers written and indexed without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import column, plain, slices
from .shared import saved

#: A sample is one 24 x 24 picture of 8-bit grey.
SIDE = 24
SAMPLE = SIDE * SIDE
#: Samples in a chunk; each chunk begins with a sync sample (keyframe).
CHUNK = 8
#: Samples a second.
RATE = 25
#: Box types that hold boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes within boxes that are walked; what lies deeper is not.
DEEPEST = 32


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _table(kind: bytes, values: np.ndarray, width: str = ">u4", rows: int | None = None) -> bytes:
    return box(kind, struct.pack(">II", 0, len(values) if rows is None else rows), values.astype(width).tobytes())


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_container(payload: bytes) -> bytes:
    """A container whose samples are the payload's SAMPLE-byte pieces; len(payload) is a multiple of SAMPLE."""
    n = len(payload) // SAMPLE
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    starts = len(ftyp) + head + np.arange(0, n, CHUNK, dtype=np.int64) * SAMPLE
    full, rest = divmod(n, CHUNK)
    runs = [(1, CHUNK, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    stbl = box(
        b"stbl",
        box(b"stsd", struct.pack(">II", 0, 1), entry),
        _table(b"stts", np.array([n, 1]), rows=1),
        _table(b"stss", np.arange(1, n + 1, CHUNK)),
        _table(b"stsc", np.array(runs).reshape(-1), rows=len(runs)),
        box(b"stsz", struct.pack(">III", 0, SAMPLE, n)),
        _table(b"stco", starts) if int(starts[-1]) < 1 << 32 else _table(b"co64", starts, ">u8"),
    )
    minf = box(b"minf", box(b"vmhd", struct.pack(">IHHHH", 1, 0, 0, 0, 0)), box(b"dinf", box(b"dref", struct.pack(">II", 0, 1), box(b"url ", struct.pack(">I", 1)))), stbl)
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, RATE, n, 0x55C4, 0)), box(b"hdlr", struct.pack(">II4s", 0, 0, b"vide"), bytes(12), b"grey\0"), minf)
    tkhd = box(b"tkhd", struct.pack(">IIIIII", 7, 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
    mvhd = box(b"mvhd", struct.pack(">IIIIIIH", 0, 0, 0, RATE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((ftyp, box(b"mdat", payload), box(b"moov", mvhd, box(b"trak", tkhd, mdia))))


class Damaged(ValueError):
    """A container whose sample tables contradict each other or its size, or that keeps samples elsewhere."""


def walk(data: bytes, begin: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box types, body start, body end) of every box, parents first. Broken sizes end the walk of their parent."""
    open_boxes: list[tuple[int, int, tuple[bytes, ...]]] = [(begin, len(data) if end is None else end, ())]
    while open_boxes:
        begin, end, path = open_boxes.pop()
        if begin + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1 and begin + 16 <= end:
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            continue
        open_boxes.append((begin + size, end, path))
        here = (*path, kind)
        yield here, begin + head, begin + size
        if kind in NESTS and len(here) < DEEPEST:
            open_boxes.append((begin + head, begin + size, here))


def _numbers(data: bytes, kind: str, n: int, at: int, end: int) -> np.ndarray:
    """n numbers of a table that lies within its box."""
    if at + n * np.dtype(kind).itemsize > end:
        raise Damaged("a table is longer than its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def read_tracks(data: bytes) -> list[dict]:
    """Codec, timescale, duration, byte offset and size of each sample, and sync sample numbers (from 0) of each track.

    What is no container has no tracks. Damaged: tables that contradict each other, samples
    outside the data, and fragmented containers, whose samples have no table.
    """
    try:
        return _read_tracks(data)
    except Damaged:
        raise
    except (struct.error, ValueError, IndexError, OverflowError) as e:
        raise Damaged(f"a box is cut off ({e})") from e


def _read_tracks(data: bytes) -> list[dict]:
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"moof":
            raise Damaged("fragmented")
        if kind == b"trak":
            tracks.append({"codec": None, "timescale": 0, "duration": 0, "stsc": [], "offsets": [], "sizes": np.zeros(0, np.int64), "sync": None})
        if not tracks or b"trak" not in path:
            continue
        track = tracks[-1]
        if kind == b"mdhd":
            wide = data[at] == 1
            track["timescale"], track["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
        elif kind == b"hdlr":
            track["handler"] = data[at + 8 : at + 12].decode("latin1")
        elif kind == b"stsd":
            track["codec"] = data[at + 12 : at + 16].decode("latin1")
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            if same and n * same > len(data):
                raise Damaged("samples are larger than the data")
            track["sizes"] = np.full(n, same, np.int64) if same else _numbers(data, ">u4", n, at + 12, end)
        elif kind in (b"stss", b"stsc", b"stco", b"co64"):
            n = struct.unpack_from(">I", data, at + 4)[0]
            values = _numbers(data, ">u8" if kind == b"co64" else ">u4", n * (3 if kind == b"stsc" else 1), at + 8, end)
            if kind == b"stss":
                track["sync"] = values - 1
            else:
                track["stsc" if kind == b"stsc" else "offsets"] = values.reshape(-1, 3) if kind == b"stsc" else values
    for track in tracks:
        n, chunks, runs = len(track["sizes"]), len(track["offsets"]), track.pop("stsc")
        first = np.array([r[0] - 1 for r in runs] + [chunks], np.int64)
        if (np.diff(first) < 0).any() or len(runs) and (first[0] or sum(int(k) * int(m) for k, m in zip(np.diff(first), (r[1] for r in runs))) != n) or n and not len(runs):
            raise Damaged("chunks and samples don't match")
        per_chunk = np.repeat(np.array([r[1] for r in runs], np.int64), np.diff(first)) if len(runs) else np.zeros(0, np.int64)
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[:n]
        ends = np.cumsum(track["sizes"])[: len(chunk)]
        begins = ends - track["sizes"][: len(chunk)]
        opens = np.zeros(len(per_chunk), np.int64)
        np.cumsum(per_chunk[:-1], out=opens[1:])
        base = begins[opens[chunk]] if n else begins
        track["at"] = np.asarray(track.pop("offsets"), np.int64)[chunk] + begins - base if n else begins
        track["sync"] = np.arange(n) if track["sync"] is None else track["sync"]
        if n and (track["at"].min() < 0 or (track["at"] + track["sizes"]).max() > len(data) or len(track["sync"]) and not 0 <= track["sync"].min() <= track["sync"].max() < n):
            raise Damaged("samples lie outside the data")
    return tracks


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): every text as samples of a container. Null text: empty; a payload has one sample at least."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            raw = plain(column(part, "_text")).cast(pa.binary()).to_pylist()
            media = [write_container(x + b"\xff" * (-len(x) % SAMPLE if x else SAMPLE)) for x in raw]
            yield pa.record_batch([column(part, "_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(put, f"`{id_col}` {id_type}, n_bytes long, media binary")


def index_media(stored: DataFrame, id_col: str = "doc_id", tail: int = SAMPLE) -> DataFrame:
    """Per container: codec, handler, timescale, duration, n_samples, keyframes (start and length of each sync sample's bytes), digests of the samples' bytes (tail_crc32: of the last ``tail`` ones) and of the container, and problem. Nothing is decoded; null containers give null features, damaged ones null features of their tracks and a reason (problem)."""
    id_type = stored.schema[id_col].dataType.simpleString()

    def look(data: bytes) -> tuple:
        try:
            track = next(iter(read_tracks(data)), None)
        except Damaged as e:
            return (None,) * 9 + (len(data), hashlib.sha256(data).hexdigest(), str(e))
        if track is None:
            return None, None, None, None, 0, [], 0, hashlib.sha256(b"").hexdigest(), 0, len(data), hashlib.sha256(data).hexdigest(), None
        at, size = track["at"], track["sizes"]
        breaks = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1  # samples that lie together are read together
        firsts = np.concatenate([[0], breaks]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        lasts = np.append(firsts[1:], len(at)) - 1
        spans = [data[at[a] : at[b] + size[b]] for a, b in zip(firsts, lasts)]
        payload = spans[0] if len(spans) == 1 else b"".join(spans)
        sync = track["sync"]
        keys = [{"start": int(a), "length": int(b)} for a, b in zip(at[sync], size[sync])]
        return track["codec"], track.get("handler"), track["timescale"], track["duration"], len(at), keys, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(data), hashlib.sha256(data).hexdigest(), None

    names = ["codec", "handler", "timescale", "duration", "n_samples", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "problem"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            rows = [look(x) if x is not None else (None,) * len(names) for x in column(part, "media").to_pylist()]
            yield pa.record_batch([column(part, id_col), column(part, "n_bytes"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], [id_col, "n_bytes", *names])

    return stored.mapInArrow(read, f"`{id_col}` {id_type}, n_bytes long, codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,length:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, problem string")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: int = SAMPLE) -> DataFrame:
    """Stores every text as media in the shared folder, reads the table back and indexes it.

    One row per input row, also for null, empty and repeated ids and texts; null texts are empty
    ones. tail_crc32 is of the payload's last ``tail`` bytes. feature: JSON of codec, handler, timescale, duration, samples and keyframe ranges.
    """
    seen = index_media(saved(store_media(docs, id_col, text_col)), id_col, tail)
    feature = F.to_json(F.struct("codec", "handler", "timescale", "duration", "n_samples", F.transform("keyframes", lambda k: F.array(k["start"], k["length"])).alias("keyframes")))
    return seen.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
