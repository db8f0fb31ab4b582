"""Token files: id blocks transposed into bit planes, each compressed by zstandard, with a chunk index.

A file image is: MAGIC; the chunks' compressed planes; the compressed directory of documents
(ids, null marks, token counts); the chunk index; the footer. Each chunk's index row has its
place, first id, number of ids and planes, and each plane's compressed size follows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import column, slices
from .shared import scratch_dir
from .tokens import library_encoder

MAGIC = b"BITPLN01"
#: Ids in a chunk.
CHUNK = 1 << 16
#: A file ends with the document that brings it to this many ids.
FILE_IDS = 1 << 22
#: So many files' starts are sent to all tasks; those of more files are joined by a shuffle.
BROADCAST_FILES = 500_000
CHUNK_ROW = struct.Struct("<QQIB")
FOOTER = struct.Struct("<QQQII8s")


def pack_planes(ids: np.ndarray) -> list[bytes]:
    """Plane k: bit k of every id, most significant plane last; as many planes as the largest id needs (one at least)."""
    planes = max(1, int(ids.max(initial=0)).bit_length())
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    bits = [np.packbits((octets[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)).tobytes() for k in range(planes)]
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(x) for x in bits]


def unpack_planes(planes: list[bytes], count: int) -> np.ndarray:
    ids = np.zeros(count, np.uint32)
    loosen = zstandard.ZstdDecompressor()
    for k, plane in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(loosen.decompress(plane), np.uint8), count=count)
        ids |= bits.astype(np.uint32) << np.uint32(k)
    return ids


def write_file(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    body, index, at = [MAGIC], [], len(MAGIC)
    for k in range(0, len(ids), CHUNK):
        own = ids[k : k + CHUNK]
        planes = pack_planes(own)
        index.append(CHUNK_ROW.pack(at, k, len(own), len(planes)) + struct.pack(f"<{len(planes)}I", *map(len, planes)))
        body += planes
        at += sum(map(len, planes))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    directory = zstandard.ZstdCompressor(level=3).compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes() + counts.astype("<i8").tobytes())
    rows = b"".join(index)
    return b"".join([*body, directory, rows, FOOTER.pack(at, at + len(directory), len(doc_ids), len(index), 0, MAGIC)])


def read_chunks(image: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first id's number, ids) of each chunk, by the index."""
    _, at, _, chunks, _, magic = FOOTER.unpack_from(image, len(image) - FOOTER.size)
    if magic != MAGIC or image[: len(MAGIC)] != MAGIC:
        raise ValueError("not a bit-plane file")
    for _ in range(chunks):
        place, first, count, planes = CHUNK_ROW.unpack_from(image, at)
        sizes = struct.unpack_from(f"<{planes}I", image, at + CHUNK_ROW.size)
        at += CHUNK_ROW.size + 4 * planes
        ends = place + np.cumsum(sizes)
        yield first, unpack_planes([image[e - s : e] for e, s in zip(ends.tolist(), sizes)], count)


def read_file(image: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """All ids, and the documents' ids and token counts in order."""
    begin, end, docs, *_ = FOOTER.unpack_from(image, len(image) - FOOTER.size)
    raw = zstandard.ZstdDecompressor().decompress(image[begin:end])
    ids = np.concatenate([np.zeros(0, np.uint32), *(x for _, x in read_chunks(image))])
    known = np.frombuffer(raw, np.uint8, docs, 8 * docs)
    doc_ids = [x if k else None for x, k in zip(np.frombuffer(raw, "<i8", docs).tolist(), known)]
    return ids, doc_ids, np.frombuffer(raw, "<i8", docs, 9 * docs)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all ids in ascending order of id_col (nulls first) as file images, rows of a Parquet table at ``path``.

    Columns: part and seq order the files, n_ids and n_docs say what is in ``image``. The table is
    written by Spark, so that any store that Spark reaches will do.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = library_encoder(tokenizer, True), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, list, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, seq
            ids, doc_ids, counts = (np.concatenate([x[0] for x in held]), [y for x in held for y in x[1]], np.concatenate([x[2] for x in held]))
            row = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([write_file(ids, doc_ids, counts)], pa.binary())], ["part", "seq", "n_ids", "n_docs", "image"])
            held, size, seq = [], 0, seq + 1
            return row

        for batch in slices(batches, "_text", 6 << 20):
            ids, at = encoder(column(batch, "_text"))
            counts = np.diff(at) + 1
            ids = np.insert(ids, at[1:], end_id)
            held.append((ids, column(batch, "_id").to_pylist(), counts))
            size += len(ids)
            if size >= FILE_IDS:
                yield close()
        if held:
            yield close()

    ordered = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).repartitionByRange("_id").sortWithinPartitions("_id")
    ordered.mapInArrow(put, "part int, seq int, n_ids long, n_docs long, image binary").write.option("compression", "none").parquet(path)


def read_token_files(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of the table of file images: id_col, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = df.select("part", "seq", "n_ids")  # a row a file
    starts = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    starts = F.broadcast(starts) if files.count() <= BROADCAST_FILES else starts

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, doc_ids, counts = read_file(column(batch, "image")[i].as_py())
                stored, ends = ids.astype("<u4"), np.cumsum(counts)
                crc = [zlib.crc32(stored[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist())]
                base = column(batch, "base")[i].as_py()
                yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return df.join(starts, ["part", "seq"]).select("image", "base").mapInArrow(look, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files to the shared folder and returns what reading them back gives.

    One row per input row: null texts are empty (end_id alone), null ids come first, rows of equal
    ids follow each other in any order; an empty table gives no rows; other columns are ignored.
    """
    spark, path = docs.sparkSession, scratch_dir(docs.sparkSession)
    write_token_files(docs, tokenizer, end_id, path, id_col, text_col)
    return read_token_files(spark.read.schema("part int, seq int, n_ids long, n_docs long, image binary").parquet(path), id_col)
