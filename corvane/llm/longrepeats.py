"""Long repeats across a corpus, by run-length indexes of the places that could repeat.

Every LENGTH-byte string has one anchor, its GRAM-byte piece of least hash, so equal strings meet
under their anchor's hash. Only strings whose anchor occurs twice can repeat. What each anchor
occurrence stands for (its span: the consecutive strings that share it) is collapsed to distinct
spans with counts; the spans of anchors with several different ones are indexed, a bucket of
anchors at a time: the run-compressed Burrows-Wheeler transform with text positions and match
lengths sampled at run ends, from which each position's matching statistic streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BASE, column, flat, mix, slices
from .shared import join_counted, saved

#: Bytes of a repeated string, and of its anchor (a power of two).
LENGTH, GRAM = 200, 32
#: Bytes of spans that an index is built of, about.
INDEXED = 1 << 19
#: An anchor of more different spans is settled string by string, by counts of their digests.
VARIANTS = 8192
#: Stands between the spans of an index: no byte, so that no string runs over it.
BETWEEN = 256


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text number, start in the text, strings, anchor's place from the start) of each run of strings with one anchor."""
    n, empty = len(data), np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty, empty
    hashed = data.astype(np.uint64) + np.uint64(1)
    m = 1
    while m < GRAM:
        hashed = hashed[:-m] * np.uint64(pow(BASE, m, 1 << 64)) + hashed[m:]
        m *= 2
    hashed = mix(hashed)
    place = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    width, m = length - GRAM + 1, 1
    while 2 * m <= width:
        place = np.minimum(place[:-m], place[m:])
        m *= 2
    if m < width:
        place = np.minimum(place[: n - length + 1], place[width - m : width - m + n - length + 1])
    anchor = (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(n - length + 2, np.int32)  # starts from which a whole string lies in its text
    sizes = np.diff(offsets)
    own = np.flatnonzero(sizes >= length)
    np.add.at(fits, offsets[own], 1)
    np.add.at(fits, offsets[own] + sizes[own] - length + 1, -1)
    valid = np.cumsum(fits[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty, empty
    doc = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], n), offsets[doc + 1] - length + 1)
    return hashed[anchor[starts]], doc, starts - offsets[doc], ends - starts, anchor[starts] - starts


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks of all pieces of 7, 14, 28, ... bytes (equal pieces, equal ranks; a rank is the first place of its pieces).

    Each round doubles the pieces and sorts again only the suffixes whose piece is that of another one.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), []
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])  # 0: beyond the end
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key <<= np.uint64(9)
        key |= padded[k : n + k]
    del padded
    order = np.argsort(key).astype(np.int32)  # ties are sorted further, so that no order needs to be kept
    key, at, rank = key[order], np.arange(n, dtype=np.int32), np.empty(n, np.int32)
    ranks, size, own = [], 7, order
    while True:
        # own: the suffixes sorted in this round, which are at the places ``at`` now
        new = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        del key
        rank[own] = np.maximum.accumulate(np.where(new, at, 0)) + np.int32(1)
        ranks.append(rank.copy())
        alone = new.copy()
        alone[:-1] &= new[1:]
        if alone.all() or size >= 2 * n:
            return order, ranks
        at, own = at[~alone], own[~alone]
        beyond = own >= n - size
        key = rank[np.where(beyond, 0, own + size)].astype(np.uint64)
        key[beyond] = 0
        key |= rank[own].astype(np.uint64) << np.uint64(32)
        turn = np.argsort(key)
        key, own = key[turn], own[turn]
        order[at] = own
        size *= 2


def common(a: np.ndarray, b: np.ndarray, text: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, by the ranks of pieces."""
    n, total = len(text), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + total, b + total
        inside = (x < n) & (y < n)
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        total += np.where(same, 7 << k, 0)
    for _ in range(7):
        x, y = a + total, b + total
        total += (x < n) & (y < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])
    return total


class RunIndex:
    """The run-length index of a text: the runs of its Burrows-Wheeler transform, and samples at their heads and ends.

    The text itself is not kept: matching statistics stream from the samples, and ``restored``
    gives the text back from the runs.
    """

    def __init__(self, text: np.ndarray):
        self.size = n = len(text)
        order, ranks = suffix_array(text)
        order = np.append(n, order)  # the empty suffix comes first
        before = np.where(order > 0, text[order - 1].astype(np.int16), -1)  # the transform; nothing stands before the whole text
        edge = np.flatnonzero(before[1:] != before[:-1]) + 1
        heads, ends = np.concatenate([[0], edge]), np.concatenate([edge - 1, [n]])
        self.run_bytes, self.run_lengths = before[heads], ends - heads + 1
        up, down = heads[heads > 0], ends[ends < n]
        #: samples: text positions of run heads and ends with their match lengths
        self.head_at, self.end_at = order[up], order[down]
        self.head_match = common(order[up], order[up - 1], text, ranks)
        self.end_match = common(order[down], order[down + 1], text, ranks)

    def matching_statistics(self) -> np.ndarray:
        """Of each position, the length of its longest match elsewhere.

        The match with the suffix before (or after) a position's in order is one shorter than that
        of the position to its left, unless a run begins (ends) there: the samples give all.
        """
        best = np.zeros(self.size, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.end_at, self.end_match)):
            reach = np.zeros(self.size + 1, np.int64)
            reach[at] = at + match
            best = np.maximum(best, (np.maximum.accumulate(reach) - np.arange(self.size + 1))[:-1])
        return best

    def restored(self) -> np.ndarray:
        """The text, from the runs alone."""
        before = np.repeat(self.run_bytes, self.run_lengths)
        after = np.argsort(before, kind="stable")  # the row of each row's next suffix
        first, out, row = before[after], np.zeros(self.size, np.int16), after[0]
        for k in range(self.size):
            out[k], row = first[row], after[row]
        return out


def repeated_strings(spans: list[bytes], counts: list[int], strings: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per distinct span, the runs (from, to) of its first ``strings`` starts at which a string of ``length`` bytes begins that occurs twice: in a span that counts twice, or in two places of the spans."""
    text = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.int16), BETWEEN) for x in spans]) if spans else np.zeros(0, np.int16)
    long = RunIndex(text).matching_statistics() >= length if len(spans) > 1 else np.zeros(len(text), bool)
    out, at = [], 0
    for span, count, n in zip(spans, counts, strings):
        if count > 1:
            out.append([(0, n)])
        else:
            own = np.diff(np.concatenate([[0], long[at : at + n].astype(np.int8), [0]]))
            out.append(list(zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())))
        at += len(span) + 1
    return out


RANGES = "array<struct<a:int,b:int>>"
ARROW_RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _ranges(lists: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in lists], ARROW_RANGES)


def repeats(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_key, ranges): of each text with a repeated string, the runs of starts of such strings.

    keyed: (_key, _text); rows of equal _key have equal texts, each an occurrence of its own.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            hashed, doc, start, strings, place = anchor_runs(*flat(column(part, "_text")), length)
            yield pa.record_batch([pa.array(hashed.astype(np.int64)), column(part, "_key").take(pa.array(doc)), pa.array(start, pa.int32()), pa.array(strings, pa.int32()), pa.array(place, pa.int32())], ["h", "_key", "start", "strings", "place"])

    found = saved(keyed.mapInArrow(anchors, "h long, _key binary, start int, strings int, place int"))
    again = saved(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    wanted = join_counted(found, again, "h", "n", found.count(), "left_semi").distinct().groupBy("_key").agg(F.collect_list(F.struct("h", "start", "strings", "place")).alias("runs")).withColumnRenamed("_key", "_want")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            seen: set[bytes] = set()
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            data, offsets = flat(column(part, "_text"))
            raw, runs = data.tobytes(), column(part, "runs")
            at = runs.offsets.to_numpy()
            own = runs.flatten()
            h, start, strings, place = (own.field(k).to_numpy() for k in range(4))
            doc = np.repeat(np.arange(len(part)), np.diff(at))
            begin = offsets[doc] + start
            for i, (a, n, p) in enumerate(zip(begin.tolist(), strings.tolist(), place.tolist())):
                span = raw[a : a + n - 1 + length]
                name = hashlib.blake2b(span, digest_size=16, salt=p.to_bytes(4, "little")).digest()
                rows[0].append(name)
                rows[1].append(None if name in seen else span)
                seen.add(name)
            yield pa.record_batch([pa.array(rows[0], pa.binary()), pa.array(h), pa.array(strings), column(part, "_key").take(pa.array(doc)), pa.array(start), pa.array(rows[1], pa.binary())], ["name", "h", "strings", "_key", "start", "span"])

    cuts = keyed.join(wanted, F.col("_key") == F.col("_want")).select("_key", "_text", "runs")
    spans = saved(cuts.mapInArrow(cut, "name binary, h long, strings int, _key binary, start int, span binary"))
    distinct = saved(spans.groupBy("name", "h", "strings").agg(F.count(F.lit(1)).alias("n")))
    kinds = saved(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")))
    sorted_out = saved(join_counted(distinct, kinds, "h", "kinds", distinct.count()))
    # one span alone under its anchor: its strings repeat if it occurs twice
    alone = sorted_out.where((F.col("kinds") == 1) & (F.col("n") > 1)).select("name", F.array(F.struct(F.lit(0).alias("a"), F.col("strings").alias("b"))).alias("ranges"))
    several = sorted_out.where((F.col("kinds") > 1) & (F.col("kinds") <= VARIANTS))
    volume = several.agg(F.sum(F.col("strings") + length)).first()[0] or 0
    buckets = max(1, -(-int(volume) // INDEXED))
    texts = spans.where("span is not null").select("name", "span")
    listed = texts.join(several.select("name", "h", "strings", "n", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int").alias("bucket")), "name").dropDuplicates(["name"])

    def index(table: pa.Table) -> pa.Table:
        names, own, counts, strings = (table.column(x).to_pylist() for x in ("name", "span", "n", "strings"))
        return pa.table({"name": pa.array(names, pa.binary()), "ranges": _ranges(repeated_strings(own, counts, strings, length))})

    indexed = listed.groupBy("bucket").applyInArrow(index, f"name binary, ranges {RANGES}")
    # anchors of very many spans: each string by its digest
    crowd = sorted_out.where(F.col("kinds") > VARIANTS)
    strings = texts.join(crowd.select("name", "h", "strings", "n"), "name").dropDuplicates(["name"])
    each = strings.select("name", "n", F.explode(F.sequence(F.lit(0), F.col("strings") - 1)).alias("i"), "span").select("name", "n", "i", F.unhex(F.md5(F.substring("span", F.col("i") + 1, F.lit(length)))).alias("digest"))
    twice = each.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1")
    crowded = each.join(twice, "digest", "left_semi").groupBy("name").agg(F.collect_list(F.struct(F.col("i").cast("int").alias("a"), (F.col("i") + 1).cast("int").alias("b"))).alias("ranges"))
    marks = saved(alone.unionByName(indexed).unionByName(crowded).where(F.size("ranges") > 0))
    placed = spans.select("name", "_key", "start").distinct().join(marks, "name").select("_key", F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b"))).alias("ranges"))
    return placed.groupBy("_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def removed_spans(begins: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings starting in [begins, ends) cover; runs that touch are one."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order] - 1 + length)
    new = np.ones(len(begins), bool)
    new[1:] = begins[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return begins[first], ends[np.append(first[1:], len(begins)) - 1] if len(first) else first


def _with_ranges(docs: DataFrame, text_col: str, length: int, carry: DataFrame) -> DataFrame:
    keyed = carry.select("_key", "_text")
    ranges = repeats(keyed, length).withColumnRenamed("_key", "_own")
    return carry.join(ranges, F.col("_key") == F.col("_own"), "left").drop("_own", "_key")


def _carried(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), text.alias("_text"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("_key"))


def _spans_of(part: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    data, offsets = flat(column(part, "_text"))
    raw, ranges = data.tobytes(), column(part, "ranges").to_pylist()
    for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), ranges):
        own = own or []
        begins, ends = removed_spans(np.array([x["a"] for x in own], np.int64), np.array([x["b"] for x in own], np.int64), length)
        yield raw[a:b], begins, ends


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256: each text without the bytes that a repeated string covers.

    A string of ``length`` bytes repeats if it starts at another place too, of the same or of
    another row (rows of equal texts, ids or both count each). Strings are judged on the input and
    may overlap. Null texts are empty; every row gives one row; other columns are ignored.
    """
    rows = _with_ranges(docs, text_col, length, _carried(docs, [id_col], text_col))
    row_type = rows.schema["_row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            n, gone, spans, digests = [], [], [], []
            for text, begins, ends in _spans_of(part, length):
                n.append(len(text))
                gone.append(int((ends - begins).sum()))
                spans.append(len(begins))
                left = text if not len(begins) else b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)]))
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.record_batch([column(part, "_row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(cut, f"_row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").select("_row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """docs with the repeated strings cut out of text_col: of each removed run the whole characters go, so that the text stays valid. Null texts stay null."""
    rows = _with_ranges(docs, text_col, length, _carried(docs, docs.columns, text_col))
    row_type = rows.schema["_row"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            kept = []
            for text, begins, ends in _spans_of(part, length):
                if len(begins):
                    edge = np.append((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, True)  # characters begin here
                    chars = np.flatnonzero(edge)
                    begins = chars[np.searchsorted(chars, begins)]
                    ends = np.maximum(begins, chars[np.searchsorted(chars, ends, "right") - 1])
                    text = b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(text)]))
                kept.append(text.decode())
            yield pa.record_batch([column(part, "_row"), pa.array(kept, pa.string())], ["_row", "_kept"])

    left = rows.mapInArrow(cut, f"_row {row_type}, _kept string")
    return left.select(*[(F.when(F.col(f"_row.`{c}`").isNotNull(), F.col("_kept")) if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
