"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BASE, MASK, column, flat, give_back, mix, shingles, slices
from .graph import components
from .shared import saved

#: Words of a shingle, and the weighted Jaccard similarity of near duplicates.
WORDS, SIMILAR = 5, 0.8
#: Bands of samples: a pair at SIMILAR by the sampled weights shares none with probability (1 - SIMILAR**ROWS)**BANDS, 4 in 10 million; one at 2 / 3 by them, 2 in 1,000.
BANDS, ROWS = 28, 4
#: For sampling alone, shingles' document frequencies are counted in so many cells; what the other shingles of a cell are sure to add is taken off again.
CELLS = 1 << 18
#: Text whose shingles are counted together before they go to the other machines.
COUNTED = 8 << 20
#: Ranges of shingles that are summed up one at a time: 2**LEAST_BITS, or as many as leave RANGE bytes of text to one.
LEAST_BITS, RANGE = 10, 4 << 20
#: For sampling alone, weights are rounded to powers of e**(1 / STEPS).
STEPS = 8
#: Shingles that are sampled together, so that what a step needs stays in a core's cache.
TOGETHER = 1 << 15
#: Levels whose draws a worker keeps, 1.8 MB each.
LEVELS = 64
#: Draws of the sampling; shingles share them by hash and are told apart by more bits of it.
DRAWS = 1 << 12
#: Rarities are from 1 to 2, so a sampled weight is from 1 / 2 to 1 of the true one, before it is rounded; like texts' sampled weights differ by no larger factor than this.
ROOM = SIMILAR / 2 * float(np.exp(-1 / STEPS))
#: Members of a bucket whose pairs become rows; the pairs of a larger one are compared block by block.
CLOSE = 32
#: Members, and bytes of their shingles, of a block of a large bucket's members.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Columns of the matrices by which two blocks are compared.
WIDE = 2048


def weighted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles of each text in order, how often each occurs, and of which text."""
    hashed, doc = shingles(data, offsets, WORDS)
    own, count = np.unique((doc.astype(np.uint64) << np.uint64(48)) | (hashed >> np.uint64(16)), return_counts=True)
    return own & np.uint64((1 << 48) - 1), count, (own >> np.uint64(48)).astype(np.int64)


def cells(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(48 - CELLS.bit_length() + 1)).astype(np.int64)


def frequencies(counts: DataFrame) -> np.ndarray:
    """Of each cell the sum over its shingles of shingle_counts, CELLS numbers whatever the corpus."""
    summed = counts.groupBy(F.shiftrightunsigned("shingle", 48 - CELLS.bit_length() + 1).cast("int").alias("cell")).agg(F.sum("held").alias("n")).toArrow()
    total = np.zeros(CELLS, np.int64)
    total[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return total


def at_most(total: np.ndarray) -> np.ndarray:
    """Bounds of the document frequencies of each cell's shingles: its count without the least that the other shingles of a cell add, by the median cell less four deviations."""
    middle = float(np.median(total))
    return np.maximum(1, total - int(max(0.0, middle - 4 * np.sqrt(middle))))


def rarity(frequency: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency, from 1 (in every text) to 2 (in one)."""
    return 1 + np.log((n + 1) / np.clip(frequency, 1, n + 1)) / np.log(n + 2)


def levels(count: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Rounded logarithms of the weights: occurrences times rarity."""
    return np.rint(STEPS * np.log(count * rare)).astype(np.int64)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c (Gamma of shape 2) and beta (uniform) of every sample and draw."""
    rng = np.random.Generator(np.random.PCG64(20))
    shape = (BANDS * ROWS, DRAWS)
    return rng.gamma(2, 1, shape), np.log(rng.gamma(2, 1, shape)), rng.random(shape)


def _order(level: int) -> np.ndarray:
    """ln a of every sample and draw at this weight, as integers of the same order."""
    r, c, beta = _draws()
    t = np.floor(level / STEPS / r + beta)
    a = c - r * (t - beta) - r
    return np.clip((a + 64) * (1 << 25), 0, (1 << 32) - 1).astype(np.uint32)


_met: list[np.ndarray] = []


def _ranks(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct levels in a table of _order (samples x levels x draws); a worker holds one, of the levels that it has met, up to LEVELS or those asked for."""
    known, table = _met or (np.zeros(0, np.int64), np.zeros((BANDS * ROWS, 0, DRAWS), np.uint32))
    new = np.setdiff1d(level, known)
    if len(new):
        if len(known) + len(new) > LEVELS:
            known, table, new = known[:0], table[:, :0], level
        known, table = np.concatenate([known, new]), np.concatenate([table, *(_order(int(x))[:, None] for x in new)], axis=1)
        _met[:] = known, table
    order = np.argsort(known)
    return order[np.searchsorted(known, level, sorter=order)], table


def signatures(shingle: np.ndarray, level: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Band hashes (texts x BANDS); texts without shingles get zeros."""
    out = np.zeros((texts, BANDS), np.uint64)
    if not len(shingle):
        return out
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    own, place = np.unique(level, return_inverse=True)
    slot, table = _ranks(own)
    base = (slot * DRAWS).astype(np.uint64)[place]
    cuts = range(0, len(shingle), TOGETHER)
    held = [np.searchsorted(first, [at, at + TOGETHER]) for at in cuts]
    spare, drawn = np.empty((3, min(TOGETHER, len(shingle))), np.uint64), np.empty(min(TOGETHER, len(shingle)), np.uint32)
    bands = np.zeros((len(first), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        ranks = table[k].reshape(-1)
        least = np.full(len(first), MASK, np.uint64)
        for at, (low, high) in zip(cuts, held):
            part = shingle[at : at + TOGETHER]
            x, y, ranked = spare[:, : len(part)]
            np.multiply(part, np.uint64(pow(BASE, 2 * k + 3, 1 << 64)), out=x)
            np.right_shift(x, np.uint64(29), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint64(0xBF58476D1CE4E5B9), out=x)
            np.right_shift(x, np.uint64(52), out=y)
            np.add(y, base[at : at + TOGETHER], out=y)
            ranked[:] = np.take(ranks, y.view(np.int64), out=drawn[: len(part)], mode="clip")
            np.left_shift(ranked, np.uint64(32), out=ranked)
            np.right_shift(x, np.uint64(20), out=x)
            np.bitwise_and(x, np.uint64(0xFFFFFFFF), out=x)
            np.bitwise_or(ranked, x, out=ranked)
            # the first text may have begun in the part before
            began = low if low < len(first) and first[low] == at else low - 1
            starts = np.maximum(first[began:high] - at, 0)
            np.minimum(least[began:high], np.minimum.reduceat(ranked, starts), out=least[began:high])
        won = least & np.uint64(0xFFFFFFFF)  # the sampled shingle; its step t is left out, as in 0-bit consistent weighted sampling
        bands[:, k // ROWS] = mix(bands[:, k // ROWS] + won * np.uint64(BASE) + np.uint64(k + 1))
    out[doc[first]] = bands
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two arrays of rows (shingle, bits of its weight), sorted by shingle."""
    (ha, hb), (wa, wb) = (a[:, 0], b[:, 0]), (np.ascontiguousarray(x[:, 1]).view(np.float64) for x in (a, b))
    at = np.minimum(np.searchsorted(hb, ha), max(0, len(hb) - 1))
    same = np.flatnonzero(hb[at] == ha) if len(hb) else np.zeros(0, np.int64)
    least = np.minimum(wa[same], wb[at[same]]).sum()
    total = wa.sum() + wb.sum() - least
    return float(least / total) if total else 0.0


def _leveled(rare: np.ndarray, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, count, doc = weighted(*flat(column(part, "_text")))
    return own, levels(count, rare[cells(own)]), doc


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, weight and text number of the shingles of packed texts."""
    data, at = flat(packed)
    whole = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2)
    shingle, weight = (np.ascontiguousarray(whole[:, k]) for k in (0, 1))
    return shingle, weight.view(np.float64), np.repeat(np.arange(len(packed)), np.diff(at) // 16)


def similarities(x: tuple, n: int, y: tuple, m: int) -> np.ndarray:
    """Weighted Jaccard (n x m) of each of n texts with each of m; texts are (shingle, weight, text number) of their shingles."""
    (hx, wx, dx), (hy, wy, dy) = x, y
    most = np.bincount(dx, wx, n)[:, None] + np.bincount(dy, wy, m)[None, :]
    shared = np.intersect1d(hx, hy)
    kept = [(h[k], w[k], d[k] + shift) for h, w, d, shift in ((hx, wx, dx, 0), (hy, wy, dy, n)) if (k := np.isin(h, shared)) is not None]
    h, w, d = (np.concatenate(z) for z in zip(*kept))
    # the lesser of two weights is the sum of the steps between a shingle's weights that both reach
    order = np.lexsort((w, h))
    h, w, d = h[order], w[order], d[order]
    other = np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0
    new = other | (np.diff(w, prepend=-1) != 0)
    step, first = np.cumsum(new) - 1, np.maximum.accumulate(np.where(other, np.cumsum(new) - 1, 0))
    tall = w[new] - np.where(other[new], 0, np.concatenate([[0], w[new][:-1]]))
    reached = step - first + 1
    row, col = np.repeat(d, reached), np.repeat(step, reached) - (np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    least = np.zeros((n, m))
    for at in range(0, len(tall), WIDE):
        a, b = np.searchsorted(col, [at, at + WIDE])
        held = np.zeros((n + m, min(WIDE, len(tall) - at)))
        held[row[a:b], col[a:b] - at] = 1
        least += (held[:n] * tall[at : at + WIDE]) @ held[n:].T
    return least / np.maximum(most - least, 1e-300)


def _bucketed(rows: pa.Table, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its large bands of this group, and of groups before it, by slot; 0: none."""
    lists = rows["larges"].combine_chunks()
    doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    slot, band, home = (lists.flatten().field(k).to_numpy() for k in ("slot", "band", "home"))
    out = []
    for mine in (home == group, home < group):
        bands = np.zeros((len(lists), BANDS), np.int64)
        bands[doc[mine], slot[mine]] = band[mine]
        out.append(bands)
    return tuple(out)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each of x has a band with each of y."""
    out = np.zeros((len(x), len(y)), bool)
    for k in range(BANDS):
        out |= (x[:, k, None] == y[None, :, k]) & (x[:, k, None] != 0)
    return out


def _forest(like: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric matrix that join all that it joins."""
    new, kept = np.ones(len(like), bool), []
    for start in range(len(like)):
        new[start] = False
        stack = [start]
        while stack:
            at = stack.pop()
            met = np.flatnonzero(like[at] & new)
            new[met] = False
            stack += met.tolist()
            kept += [(at, x) for x in met.tolist()]
    return kept


def compare_blocks(key: tuple, rows: pa.Table) -> pa.Table:
    """Compares the members of two blocks of a group, or of one with each other: (a, null, links of a), and (a, b, 0) of links that join the same texts as all.

    A pair is compared if it shares a large bucket of this group and none of a group before, so
    that each pair is compared in one group.
    """
    group, low, high = (k.as_py() for k in key)
    low_rows, high_rows = (rows.filter(pc.equal(rows["block"], k)) for k in (low, high))
    names = [z["node"].to_pylist() for z in (low_rows, high_rows)]
    n, m = map(len, names)
    out: tuple[list, list, list] = ([], [], [])
    if n and m:
        (own_x, old_x), (own_y, old_y) = (_bucketed(z, group) for z in (low_rows, high_rows))
        asked = _shared(own_x, own_y) & ~_shared(old_x, old_y)
        if low == high:
            np.fill_diagonal(asked, False)
        if asked.any():
            x, y = (_unpacked(z["packed"].combine_chunks()) for z in (low_rows, high_rows))
            like = asked & (similarities(x, n, y, m) >= SIMILAR - 1e-9)
            if low == high:
                like |= like.T
                nodes, whole = names[0], like
            else:
                nodes, whole = names[0] + names[1], np.block([[np.zeros((n, n), bool), like], [like.T, np.zeros((m, m), bool)]])
            count = whole.sum(1)
            for at in np.flatnonzero(count).tolist():
                out[0].append(nodes[at]), out[1].append(None), out[2].append(int(count[at]))
            for a, b in _forest(whole):
                out[0].append(nodes[a]), out[1].append(nodes[b]), out[2].append(0)
    return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["a", "b", "n"])


def candidates(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (band, slot, node, weight) that share a band, each pair of them in one of two ways.

    Pairs: distinct (a, b), a < b, of those that share buckets of up to CLOSE members only, and
    whose sampled weights leave room for SIMILAR. Of larger buckets, groups of those with the same least
    node: (home, node); and per node its large bands (slot, band, home). Bands with the same
    members count once.
    """
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    once = buckets.groupBy("n", "least", "most", "all").agg(F.min("band").alias("band"))
    own = saved(members.join(once.select("band", "n", F.xxhash64("least").alias("home")), "band"))
    room = F.least(F.col("weight"), F.col("weight2")) >= ROOM * F.greatest(F.col("weight"), F.col("weight2"))
    large = own.where(F.col("n") > CLOSE)
    larges = saved(large.groupBy("node").agg(F.collect_list(F.struct("slot", "band", "home")).alias("larges")))
    many = F.coalesce(F.col("larges.band"), F.array().cast("array<long>"))
    small = own.where(F.col("n") <= CLOSE).join(larges, "node", "left").select("band", "node", "weight", many.alias("many"))
    other = small.select("band", F.col("node").alias("node2"), F.col("weight").alias("weight2"), F.col("many").alias("many2"))
    met = small.join(other, "band").where((F.col("node") < F.col("node2")) & room & ~F.arrays_overlap("many", "many2"))
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), large.select("home", "node").distinct(), larges


def crowded(groups: DataFrame, larges: DataFrame, sets: DataFrame) -> DataFrame:
    """What compare_blocks finds in all groups: their members are dealt to blocks, and each two blocks of a group are compared, so that no task holds a group and no pair is left out."""
    sized = groups.join(sets, "node").groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("packed")).alias("bytes"))
    blocks = sized.select("home", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = groups.join(blocks, "home").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("home", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node")
    rows = met.join(larges, "node").join(sets, "node")
    return saved(rows.groupBy("home", "low", "high").applyInArrow(compare_blocks, "a binary, b binary, n long"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, class_id (least id of the row's class), n_links (other texts that its text is linked to).

    A class holds equal texts and all that links of weighted Jaccard SIMILAR or more over
    shingles of WORDS words join; weights are occurrences times rarity. A text of fewer words is
    one shingle; texts without words are like their equals alone. Null texts are empty ones. A
    class whose ids are all null has a null class_id. Every row gives one row, an empty table
    none; other columns are ignored.
    """
    rows, by_text = _classes(_keyed(docs, id_col, text_col))
    return rows.join(by_text, "_key").select(F.col("_id").alias(id_col), F.col("first._id").alias("class_id"), "n_links")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each class: of the least id that isn't null, then of the least digest of its text; of repeated rows any one."""
    key = F.unhex(F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")))
    _, by_text = _classes(_keyed(docs, id_col, text_col))
    kept = by_text.where(F.col("_key") == F.col("first._key")).select(F.col("_key").alias("_kept"), F.col("first._id").alias("_first"))
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), key.alias("_key"))
    return wide.join(kept, (F.col("_key") == F.col("_kept")) & F.col("_id").eqNullSafe(F.col("_first")), "left_semi").dropDuplicates(["_key"]).select("_row.*")


def shingle_counts(texts: DataFrame, size: int) -> DataFrame:
    """(shingle, held): in how many texts each shingle is that is in more than one; texts has one column, of size bytes.

    Most shingles are in one text, and a row for each costs more than all else here: workers sum
    up COUNTED bytes of text at a time and send the shingles of a range as one row, 6 bytes each;
    those that they found more than once go with their count.
    """
    name = texts.columns[0]
    bits = max(LEAST_BITS, (size // RANGE).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(48 - bits)
        waits: list[np.ndarray] = []
        size = 0

        def packed(rows: np.ndarray, at: np.ndarray) -> pa.Array:
            offsets = np.concatenate([[0], at, [len(rows)]]) * rows.shape[1]
            return pa.Array.from_buffers(pa.binary(), 1 << bits, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])

        def summed() -> pa.RecordBatch:
            own, held = np.unique(np.concatenate(waits), return_counts=True)
            once, more = own[held == 1], own[held > 1]
            counted = np.stack([more, held[held > 1].astype(np.uint64)], axis=1).view(np.uint8)
            columns = [pa.array(np.arange(1 << bits, dtype=np.int32)), packed(once.view(np.uint8).reshape(-1, 8)[:, :6], np.searchsorted(once, bounds)), packed(counted, np.searchsorted(more, bounds))]
            whole = pa.record_batch(columns, ["part", "once", "more"])
            return whole.filter(pc.greater(pc.add(pc.binary_length(whole["once"]), pc.binary_length(whole["more"])), 0))

        for part in slices(batches, name, 1 << 20):
            waits.append(weighted(*flat(column(part, name)))[0])
            size += int(pc.sum(pc.binary_length(column(part, name))).as_py() or 0)
            if size >= COUNTED:
                yield summed()
                waits, size = [], 0
        if waits:
            yield summed()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by range; the last range of a batch waits for the next one."""
        now, waits = None, []

        def summed() -> pa.RecordBatch:
            own, held = (np.concatenate(x) for x in zip(*waits))
            order = np.argsort(own)
            own, held = own[order], held[order]
            first = np.flatnonzero(np.diff(own, prepend=own[:1] ^ np.uint64(1)))
            held = np.add.reduceat(held, first)
            return pa.record_batch([pa.array(own[first][held > 1].astype(np.int64)), pa.array(held[held > 1])], ["shingle", "held"])

        for batch in batches:
            parts = column(batch, "part").to_numpy()
            cuts = np.flatnonzero(np.diff(parts, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(parts)]):
                if parts[a] != now and waits:
                    yield summed()
                    waits = []
                now = parts[a]
                once, more = (flat(column(batch, c).slice(a, b - a))[0] for c in ("once", "more"))
                wide = np.zeros((len(once) // 6, 8), np.uint8)
                wide[:, :6] = once.reshape(-1, 6)
                counted = np.frombuffer(more.tobytes(), np.uint64).reshape(-1, 2)
                waits.append((np.concatenate([wide.reshape(-1).view(np.uint64), counted[:, 0]]), np.concatenate([np.ones(len(wide), np.int64), counted[:, 1].astype(np.int64)])))
        if waits:
            yield summed()
        give_back()

    dealt = texts.mapInArrow(count, "part int, once binary, more binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(total, "shingle long, held long")


def weighed(chosen: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(_key, packed): the shingles of each text of chosen (_key, _text) with weights by the true document frequencies, as similarity takes them.

    counts: as of shingle_counts, of n texts that hold all of chosen.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            own, count, doc = weighted(*flat(column(part, "_text")))
            yield pa.record_batch([column(part, "_key").take(pa.array(doc)), pa.array(own.astype(np.int64)), pa.array(count.astype(np.int32))], ["_key", "shingle", "times"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by text; the last text of a batch waits for the next one."""
        key, waits = None, []
        for batch in batches:
            keys = column(batch, "_key")
            runs = pc.run_end_encode(keys)
            ends, names = runs.run_ends.to_numpy(), runs.values.to_pylist()
            whole = np.stack([column(batch, "shingle").to_numpy().view(np.uint64), column(batch, "weight").to_numpy().view(np.uint64)], axis=1)
            done: tuple[list, list] = ([], [])
            for name, a, b in zip(names, [0, *ends[:-1].tolist()], ends.tolist()):
                if name != key and waits:
                    done[0].append(key), done[1].append(b"".join(waits))
                    waits = []
                key = name
                waits.append(whole[a:b].tobytes())
            yield pa.record_batch([pa.array(done[0], pa.binary()), pa.array(done[1], pa.binary())], ["_key", "packed"])
        if waits:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([b"".join(waits)], pa.binary())], ["_key", "packed"])

    rare = 1 + F.log((n + 1) / F.coalesce("held", F.lit(1))) / float(np.log(n + 2))
    rows = chosen.mapInArrow(split, "_key binary, shingle long, times int").join(counts, "shingle", "left").select("_key", "shingle", (F.col("times") * rare).alias("weight"))
    return rows.repartition("_key").sortWithinPartitions("_key", "shingle").mapInArrow(pack, "_key binary, packed binary")


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_id, _key) of all rows; and per text _key, its class's first row (struct of _id and _key) and its number of links."""
    n, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    counts = saved(shingle_counts(keyed.select("_text"), size))
    rare = rarity(at_most(frequencies(counts)), n)
    id_type = keyed.schema["_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            own, level, doc = _leveled(rare, part)
            bands = signatures(own, level, doc, len(part)).astype(np.int64)
            weight = np.bincount(doc, np.exp(level / STEPS), len(part))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
            yield pa.record_batch([column(part, "_id"), column(part, "_key"), pa.array(weight), lists], ["_id", "_key", "weight", "bands"])

    signed = saved(keyed.mapInArrow(sign, f"_id {id_type}, _key binary, weight double, bands array<long>"))
    texts = saved(signed.groupBy("_key").agg(F.min("_id").alias("least_id"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands")))
    members = texts.where("weight > 0").select(F.col("_key").alias("node"), "weight", F.posexplode("bands").alias("slot", "band"))
    pairs, groups, larges = candidates(members)
    pairs, groups = saved(pairs), saved(groups)
    wanted = pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).unionByName(larges.select(F.col("node").alias("_key"))).distinct().join(texts.select("_key", "least_id"), "_key").withColumnRenamed("_key", "_want")

    chosen = keyed.join(wanted, (F.col("_key") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("least_id")), "left_semi").select("_key", "_text").dropDuplicates(["_key"])
    sets = saved(weighed(chosen, counts, n))
    sided = pairs.join(sets.select(F.col("_key").alias("a"), F.col("packed").alias("x")), "a").join(sets.select(F.col("_key").alias("b"), F.col("packed").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (xs, x_at), (ys, y_at) = (flat(column(batch, c)) for c in ("x", "y"))
            xs, ys, x_at, y_at = xs.view(np.uint64).reshape(-1, 2), ys.view(np.uint64).reshape(-1, 2), x_at // 16, y_at // 16
            like = [similarity(xs[a:b], ys[c:d]) >= SIMILAR - 1e-9 for a, b, c, d in zip(x_at[:-1], x_at[1:], y_at[:-1], y_at[1:])]
            yield batch.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    links = saved(sided.select("a", "b", "x", "y").mapInArrow(verify, "a binary, b binary"))
    blocks = crowded(groups, larges, sets.withColumnRenamed("_key", "node"))
    one = F.lit(1).cast("long").alias("n")
    ends = links.select(F.col("a").alias("node"), one).unionAll(links.select(F.col("b").alias("node"), one)).unionAll(blocks.where("b is null").select(F.col("a").alias("node"), "n"))
    degree = ends.groupBy("node").agg(F.sum("n").alias("n_links"))
    labels = components(links.unionAll(blocks.where("b is not null").select("a", "b"))).join(degree, "node")
    named = texts.select("_key", "least_id").join(labels, F.col("_key") == F.col("node"), "left").select("_key", "least_id", F.coalesce("label", "_key").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classes = named.groupBy("label").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("_id"), "_key")).alias("first"))
    return signed.select("_id", "_key"), named.join(classes, "label").select("_key", "first", "n_links")
