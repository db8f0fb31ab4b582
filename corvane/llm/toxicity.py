"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import codepoints, column, flat, give_back, letter_words, shingles, slices
from .labelled import fold, sample

#: Examples of each label that the index holds at most.
PER_CLASS = 3000
#: Neighbours that vote: one in SPREAD of the examples, within these bounds.
FEWEST, NEIGHBOURS, SPREAD = 15, 256, 16
#: Places that are left free vote for the share of label 1, as examples at this cosine would.
FAR = 0.05
#: Examples in a block.
BLOCK = 64
#: Terms with the longest lists of postings: their lists are visited block by block, the others are short and read whole.
LONG = 512
#: Examples that the others are put in order by, so that blocks hold like ones.
PIVOTS = 16
#: Blocks of each text that are scored first, and texts that are scored together.
FIRST, TOGETHER = 6, 128
#: Bins of votes that calibration fits probabilities to; an example's like texts don't vote for it there.
BINS = 20


def term_counts(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text, how often, and of which text; and the least shingle of each text, the same for most near copies."""
    data, offsets = flat(array)
    hashed, doc = letter_words(*codepoints(data, offsets))
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    least = np.full(len(array), np.iinfo(np.uint64).max)
    np.minimum.at(least, *shingles(data, offsets, 5)[::-1])
    return hashed[first], count, doc[first], least


def _alike(rows: np.ndarray) -> np.ndarray:
    """An order that puts like rows side by side: by the nearest of a few pivots far from each other, then by nearness to it."""
    near = np.zeros((len(rows), 0))
    pivot = 0
    for _ in range(min(PIVOTS, len(rows))):
        near = np.column_stack([near, rows @ rows[pivot]])
        pivot = int(near.max(1).argmin())
    return np.lexsort((-near.max(1), near.argmax(1))) if len(rows) else np.zeros(0, np.int64)


#: What an index makes of its counts when it reaches a worker.
EXPANDED = ("postings", "most", "weight")


class Index:
    """An inverted index of examples in blocks of BLOCK, with the largest weight of each long list in each block.

    Vectors: (1 + ln tf) * idf over the index's terms, which are all terms of the examples, of length 1.
    k: how many neighbours vote.
    """

    def __init__(self, terms: np.ndarray, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list[int], group: np.ndarray, weights: np.ndarray):
        self.terms, self.idf, n = terms, idf, len(rows)
        which = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)])
        owner = np.repeat(np.arange(n), [len(t) for t, _ in rows])
        count = np.concatenate([np.zeros(0, np.int64), *(c for _, c in rows)]).astype(np.int32)
        norm = self.norms(owner, which, count, n)
        held = np.bincount(which, minlength=len(terms))
        long = np.argsort(-held, kind="stable")[: min(LONG, int((held > 0).sum()))]
        self.long = np.full(len(terms), -1, np.int16)
        self.long[long] = np.arange(len(long))
        self.blocks, own = max(1, -(-n // BLOCK)), self.long[which] >= 0
        self.long_terms, self.norm = long, norm
        self.long_lists = owner[own].astype(np.int32), self.long[which[own]], count[own]
        self.number = _alike(self._dense(n))  # the example at each place
        place = np.empty(n, np.int64)
        place[self.number] = np.arange(n)
        self.norm = norm[self.number]
        self.long_lists = place[self.long_lists[0]].astype(np.int32), *self.long_lists[1:]
        own = np.flatnonzero(~own)
        own = own[np.argsort(which[own], kind="stable")]
        self.begin = np.searchsorted(which[own], np.arange(len(terms) + 1)).astype(np.int32)
        self.example, self.count = place[owner[own]].astype(np.int32), count[own]
        self.labels, self.group, self.weights = labels[self.number], group[self.number], weights[self.number]
        self.ids = [ids[i] for i in self.number.tolist()]
        self.share = float(labels.mean()) if n else 0.5
        self.k = max(FEWEST, min(NEIGHBOURS, n // SPREAD))
        self._expand()

    def _dense(self, size: int) -> np.ndarray:
        """The long lists' weights, examples x long terms."""
        dense = np.zeros((size, len(self.long_terms)))
        place, column, count = self.long_lists
        dense[place, column] = (1 + np.log(count)) * self.idf[self.long_terms[column]] / self.norm[place]
        return dense

    def _expand(self) -> None:
        """Weights and block maxima, from counts and norms."""
        self.postings = self._dense(self.blocks * BLOCK).reshape(self.blocks, BLOCK, len(self.long_terms))
        self.most = self.postings.max(1)
        self.weight = (1 + np.log(self.count)) * self.idf[np.repeat(np.arange(len(self.terms)), np.diff(self.begin))] / self.norm[self.example]

    def __getstate__(self) -> dict:
        """What goes to workers: a third of what they make of it."""
        return {k: x for k, x in self.__dict__.items() if k not in EXPANDED}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._expand()

    def norms(self, owner: np.ndarray, which: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        weight = (1 + np.log(count)) * self.idf[which]
        norm = np.sqrt(np.bincount(owner, weight * weight, texts))
        return np.where(norm > 0, norm, 1)

    def vectors(self, owner: np.ndarray, which: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
        return (1 + np.log(count)) * self.idf[which] / self.norms(owner, which, count, texts)[owner]

    def nearest(self, owner: np.ndarray, which: np.ndarray, count: np.ndarray, texts: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, places), texts x k: of each text the nearest examples with a common term, the nearest first; ties by example, place -1 where there are no more.

        owner (rising), which and count are the terms of the texts. A block whose bound cannot beat
        the last of a text's neighbours is not scored for it. without: a text's group, whose
        examples are left out.
        """
        weight = self.vectors(owner, which, count, texts)
        cosines, places = np.zeros((texts, self.k)), np.full((texts, self.k), -1)
        for a in range(0, texts, TOGETHER):
            n = min(TOGETHER, texts - a)
            i, j = np.searchsorted(owner, [a, a + n])
            found = self._scored(owner[i:j] - a, which[i:j], weight[i:j], n, None if without is None else without[a : a + n])
            last = self._last(found)
            text, place = np.nonzero((found >= np.maximum(last, 1e-12)[:, None]) & (found > 0))
            score = found[text, place]
            order = np.lexsort((self.number[place], -score, text))
            text, place, score = text[order], place[order], score[order]
            rank = np.arange(len(text)) - np.searchsorted(text, text)
            own = rank < self.k
            cosines[a + text[own], rank[own]], places[a + text[own], rank[own]] = score[own], place[own]
        return cosines, places

    def _last(self, found: np.ndarray) -> np.ndarray:
        """The k-th largest cosine of each text."""
        at = found.shape[1] - min(self.k, found.shape[1])
        return np.partition(found, at, 1)[:, at]

    def _scored(self, owner: np.ndarray, which: np.ndarray, weight: np.ndarray, texts: int, without: np.ndarray | None) -> np.ndarray:
        """Cosines (texts x places) of all blocks that could hold a neighbour; -1 elsewhere."""
        size = self.blocks * BLOCK
        own = self.long[which] >= 0
        query = np.zeros((texts, self.most.shape[1]))
        query[owner[own], self.long[which[own]]] = weight[own]
        own = np.flatnonzero(~own)
        begin, lists = self.begin[which[own]], self.begin[which[own] + 1] - self.begin[which[own]]
        at = np.repeat(begin - np.cumsum(lists) + lists, lists) + np.arange(lists.sum())
        short = np.bincount(np.repeat(owner[own], lists) * size + self.example[at], np.repeat(weight[own], lists) * self.weight[at], texts * size).reshape(texts, self.blocks, BLOCK)
        bound = query @ self.most.T + short.max(2)
        found = np.full((texts, self.blocks, BLOCK), -1.0)
        todo = np.zeros((texts, self.blocks), bool)
        np.put_along_axis(todo, np.argsort(-bound, 1, kind="stable")[:, :FIRST], True, 1)
        done = np.zeros_like(todo)
        while todo.any():
            for b in np.flatnonzero(todo.any(0)):
                t = np.flatnonzero(todo[:, b])
                found[t, b] = np.round(query[t] @ self.postings[b].T + short[t, b], 10)
            done |= todo
            flat = found.reshape(texts, size)
            if without is not None:
                flat[:, : len(self.group)][self.group[None, :] == without[:, None]] = -1
            todo = ~done & (bound >= np.maximum(self._last(flat), 0)[:, None] - 1e-9) & (bound > 0)
        return found.reshape(texts, size)

    def votes(self, cosines: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Share of label 1 among each text's neighbours, each weighing the square of its cosine."""
        near, free = cosines * cosines, (places < 0).sum(1) * FAR**2
        label = np.append(self.labels, 0)[places]
        total = near.sum(1) + free
        return ((near * label).sum(1) + free * self.share) / np.where(total > 0, total, 1)


def calibrate(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of votes and the probabilities there, rising (pool-adjacent-violators over BINS bins of votes)."""
    bins = np.minimum((votes * BINS).astype(int), BINS - 1)
    blocks: list[list[float]] = []
    for b in range(BINS):
        own = bins == b
        middle = float((votes[own] * weights[own]).sum() / weights[own].sum()) if own.any() else (b + 0.5) / BINS
        scale = weights.mean() if len(weights) else 1.0
        blocks.append([middle, float((weights[own] * labels[own]).sum()) / scale + 2 * middle, float(weights[own].sum()) / scale + 2, 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] > blocks[-1][1] / blocks[-1][2]:
            m, p, n, k = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[3] + m * k) / (a[3] + k), a[1] + p, a[2] + n, a[3] + k]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def telling(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, group: np.ndarray, terms: int) -> np.ndarray:
    """Of each term, how much it tells the examples' labels apart: the square root of its log-likelihood ratio (G2) with the label, over examples that hold it or not; like examples of one label count once."""
    once = np.unique(np.stack([group.astype(np.uint64), labels.astype(np.uint64)]), axis=1, return_index=True)[1]
    size = np.bincount(labels[once], minlength=2)
    found = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int64), *(rows[i][0] for i in once if labels[i] == k)]), minlength=terms) for k in (0, 1)])
    ratio = np.zeros(terms)
    for held, texts in ((found, found.sum(0)), (size[:, None] - found, size.sum() - found.sum(0))):
        for k in (0, 1):
            ratio += 2 * held[k] * np.log(np.maximum(held[k], 1) / np.maximum(texts * size[k] / max(1, size.sum()), 1e-9))
    return np.sqrt(np.maximum(ratio, 0))


def _index(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, id_col: str, text_col: str, by_labels: bool = False) -> tuple[Index | None, tuple[np.ndarray, np.ndarray], float]:
    chosen, counts = sample(docs, labels, label, folds, held_out, per_class, id_col, text_col)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            term, count, doc, least = term_counts(column(part, "_text"))
            ends = np.searchsorted(doc, np.arange(len(part) + 1))
            yield pa.record_batch(
                [column(part, "_id").cast(pa.int64()), column(part, "_label"), pa.array(least.astype(np.int64)), pa.array([term[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), pa.array([count[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                ["id", "label", "least", "terms", "counts"],
            )

    found = chosen.mapInArrow(sparse, "id long, label int, least long, terms binary, counts binary").toArrow().combine_chunks()  # 2 * per_class rows
    known, ids, group = (found[x].to_numpy().astype(t) for x, t in (("label", np.int64), ("id", np.int64), ("least", np.uint64)))
    order = np.lexsort((known, ids))
    known, ids, group = known[order], ids[order].tolist(), group[order]
    prior = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    texts = [[np.frombuffer(x.as_py(), t) for x in found[name].take(pa.array(order))] for name, t in (("terms", np.uint64), ("counts", "<i4"))]
    rows = list(zip(*texts))
    del found, texts
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in rows)]))
    if not len(terms):
        return None, (np.zeros(1), np.full(1, prior)), prior

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for part in slices(batches, "_text", 1 << 20):
            owner, which, _ = _known(terms, column(part, "_text"))
            total += np.bincount(which, minlength=len(terms))
            n += len(part)
        own = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(own, -1), pa.int32()), pa.array(np.append(total[own], n))], ["term", "n"])

    counted = docs.select(F.col(text_col).alias("_text")).mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    held = counted.toArrow()  # a row for each term of the examples
    term, n = (column(held.combine_chunks(), x).to_numpy() for x in ("term", "n"))
    frequency = np.zeros(len(terms))
    frequency[term[term >= 0]] = n[term >= 0]
    idf = np.log((1 + n[term < 0].sum()) / (1 + frequency))
    kept = [i for i, (t, _) in enumerate(rows) if len(t)]
    own_rows = [(np.searchsorted(terms, rows[i][0]).astype(np.int32), rows[i][1]) for i in kept]
    of_label = np.bincount(known, minlength=2)
    scale = np.array([counts.get(k, 0) / max(1, of_label[k]) for k in (0, 1)])
    if by_labels:
        idf *= 1 + telling(own_rows, known[kept], group[kept], len(terms))
    index = Index(terms, idf, own_rows, known[kept], [ids[i] for i in kept], group[kept], scale[known[kept]])
    give_back()
    votes = []
    for at in range(0, len(kept), TOGETHER):
        each = [own_rows[i] for i in index.number[at : at + TOGETHER].tolist()]
        owner = np.repeat(np.arange(len(each)), [len(t) for t, _ in each])
        votes.append(index.votes(*index.nearest(owner, np.concatenate([t for t, _ in each]), np.concatenate([c for _, c in each]), len(each), without=index.group[at : at + TOGETHER])))
    votes = np.concatenate(votes)
    without = np.setdiff1d(np.arange(len(rows)), kept)
    none = ((scale[known[without]] * known[without]).sum() + prior) / (scale[known[without]].sum() + 1)
    for x in EXPANDED:  # workers make their own
        delattr(index, x)
    del rows, own_rows, each, held
    give_back()
    return index, calibrate(votes, index.labels.astype(float), index.weights), float(none)


def _known(terms: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number (rising), place in ``terms`` and count of the distinct words of the texts that are among ``terms``."""
    hashed, doc = letter_words(*codepoints(*flat(texts)))
    hashed, back = np.unique(hashed, return_inverse=True)
    place = np.minimum(np.searchsorted(terms, hashed), len(terms) - 1)
    place = np.where(terms[place] == hashed, place, -1)[back]
    own = place >= 0
    pairs, count = np.unique(doc[own] * len(terms) + place[own], return_counts=True)
    owner, which = np.divmod(pairs, len(terms))
    return owner, which, count


def _scored(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, id_col: str, text_col: str, carry: list[str], below: float | None = None, by_labels: bool = False) -> DataFrame:
    """The columns ``carry`` as struct _row, held_out, score and evidence; of rows with a score below ``below`` only, if that is given."""
    index, (places, chances), none = _index(docs, labels, label, folds, held_out, per_class, id_col, text_col, by_labels)
    held = (fold(id_col, folds) == held_out).alias("_held")
    inside = carry.index(text_col) if text_col in carry else None  # then the text goes to Python in _row only
    text = F.col(text_col).alias("_text") if inside is None else F.octet_length(text_col).alias("_bytes")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), held, text)
    row_type = wide.schema["_row"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text" if inside is None else "_bytes", 1 << 20):
            chance, near = np.full(len(part), none), [[] for _ in range(len(part))]
            if index is not None:
                owner, which, count = _known(index.terms, column(part, "_text") if inside is None else column(part, "_row").field(inside))
                some, owner = np.unique(owner, return_inverse=True)
                cosines, found = index.nearest(owner, which, count.astype(np.float64), len(some))
                chance[some] = np.interp(index.votes(cosines, found), places, chances)
                if below is None:
                    for i, own in zip(some.tolist(), found[:, :5].tolist()):
                        near[i] = [index.ids[j] for j in own if j >= 0]
            out = pa.record_batch([column(part, "_row"), column(part, "_held"), pa.array(np.clip(chance, 0, 1)), pa.array(near, pa.list_(pa.int64()))], ["_row", "held_out", "score", "evidence"])
            yield out if below is None else out.filter(pa.array(chance < below))

    return wide.mapInArrow(score, f"_row {row_type}, held_out boolean, score double, evidence array<long>")


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score (probability of label 1), predicted, evidence (ids of the nearest examples of either label, nearest first).

    The index holds ``per_class`` labelled rows of each label at most, none of the held-out fold,
    with all their words; document frequencies are counted over all rows; every whole text is
    scored. Words of no example are left out of a text's vector. A text without any of the
    index's words (also an empty or null one) gets the share of label 1 among such examples.
    Without usable examples all scores are the labels' share. Ids can be of any type that long
    can hold. Every row gives one row, also null and repeated ids; other columns are ignored.
    """
    scored = _scored(docs, labels, label, folds, held_out, per_class, id_col, text_col, [id_col])
    return scored.select("_row.*", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below 0.5, all columns as they are.

    Scores as of ``score_documents``, but each word's idf is raised by how much the word tells the
    sampled examples' labels apart (``telling``): of a long text with few telling words, plain
    cosines see the other words only.
    """
    return _scored(docs, labels, label, folds, held_out, per_class, id_col, text_col, docs.columns, below=0.5, by_labels=True).select("_row.*")
