"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax output."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import BASE, codepoints, column, flat, mix, slices, span_hashes, words
from .labelled import fold, sample

#: Vectors; features share them by hash.
BUCKETS = 1 << 16
DIMENSIONS = 12
GRAMS = (3, 4)
EPOCHS = 8
RATE = 0.6
#: Rows of each label that the model is fitted on at most.
PER_CLASS = 1500


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of words, of words that repeat the word before them, and of character n-grams, kind by kind."""
    starts, ends, doc = words(data, offsets)
    hashed = span_hashes(data, starts, ends)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    yield (hashed >> shift).astype(np.int64), doc
    again = np.flatnonzero((hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])) + 1
    yield np.zeros(len(again), np.int64), doc[again]
    points, at = codepoints(data, offsets)
    wide = points.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in GRAMS:
        if len(points) >= n:
            total = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                total += wide[k : len(points) - n + 1 + k] * np.uint64(pow(BASE, k + 1, 1 << 64))
            within = owner[n - 1 :] == owner[: len(owner) - n + 1]
            yield (mix(total) >> shift).astype(np.int64)[within], owner[: len(owner) - n + 1][within]


@dataclass
class Model:
    """vectors: BUCKETS x DIMENSIONS; output: DIMENSIONS x 2; bias: 2."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def logit_parts(self) -> tuple[np.ndarray, float]:
        """Averaging and the output layer are linear: each bucket's share of the logit of label 1, and the rest."""
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent over texts given as (buckets, shares); each label weighs in as ``weights`` says."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32), np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32))
    model.output[:] = rng.normal(0, 0.1, model.output.shape)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, share = rows[i]
            rate = RATE * (1 - done / steps) * weights[labels[i]]
            done += 1
            hidden = share @ model.vectors[buckets] if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            odds = hidden @ model.output + model.bias
            error = np.exp(odds - odds.max())
            error /= error.sum()
            error[labels[i]] -= 1
            back = model.output @ error
            model.output -= rate * np.outer(hidden, error)
            model.bias -= rate * 0.1 * error
            if len(buckets):
                model.vectors[buckets] -= (rate * 20 * share[:, None]) * back
    return model


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out (the row's fold is the held-out one), score (probability of label 1), predicted.

    The model is fitted on ``per_class`` rows of each label at most, none of the held-out fold, and
    applied to every whole text; a text without features (empty, null) gets the score of the bias.
    With one label alone or none at all, all scores are that label's share (0.5). Every row gives
    one row, also null and repeated ids; other columns are ignored.
    """
    chosen, counts = sample(docs, labels, label, folds, held_out, per_class, id_col, text_col)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            data, offsets = flat(column(part, "_text"))
            kinds = list(features(data, offsets))
            key = np.concatenate([(doc << 20) | bucket for bucket, doc in kinds])
            own, n = np.unique(key, return_counts=True)
            ends = np.searchsorted(own >> 20, np.arange(len(part) + 1))
            yield pa.record_batch(
                [column(part, "_id").cast(pa.string()), column(part, "_label"), pa.array([(own[a:b] & 0xFFFFF).astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), pa.array([n[a:b].astype("<i4").tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                ["id", "label", "buckets", "counts"],
            )

    found = sorted(chosen.mapInArrow(sparse, "id string, label int, buckets binary, counts binary").collect(), key=lambda r: (r.id, r.buckets))
    known = np.array([r.label for r in found], np.int64)
    seen = np.bincount(known, minlength=2)
    if seen.min() == 0:
        parts, bias = np.zeros(BUCKETS, np.float32), float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    else:
        rows = []
        for r in found:
            n = np.frombuffer(r.counts, "<i4").astype(np.float32)
            rows.append((np.frombuffer(r.buckets, "<i4"), n / max(1.0, float(n.sum()))))
        parts, bias = train(rows, known, len(known) / (2 * seen)).logit_parts()
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", 1 << 20):
            data, offsets = flat(column(part, "_text"))
            total, count = np.zeros(len(part)), np.zeros(len(part))
            for bucket, doc in features(data, offsets):
                total += np.bincount(doc, parts[bucket], len(part))
                count += np.bincount(doc, minlength=len(part))
            odds = bias + total / np.maximum(count, 1)
            yield pa.record_batch([column(part, "_id"), column(part, "_held"), pa.array(1 / (1 + np.exp(-np.clip(odds, -30, 30))))], [id_col, "held_out", "score"])

    scored = docs.select(F.col(id_col).alias("_id"), (fold(id_col, folds) == held_out).alias("_held"), F.col(text_col).alias("_text")).mapInArrow(score, f"`{id_col}` {id_type}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
