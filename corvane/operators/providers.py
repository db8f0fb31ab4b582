"""Stand-ins for network models: deterministic, offline, each replaceable by a function of the same shape."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import small_batches
from .batches import runs

DIMENSIONS = 64


@lru_cache(maxsize=200_000)
def _place(term: str) -> tuple[int, int]:
    digest = hashlib.md5(term.encode()).hexdigest()
    return int(digest[:8], 16) % DIMENSIONS, 1 if int(digest[8], 16) < 8 else -1


def embed(df: DataFrame, id_col: str, text: Column, out: str = "vector") -> DataFrame:
    """(id_col, out): signed feature hashing of the text's tokens into DIMENSIONS dimensions (not normalised).

    A term's dimension is the first 8 hex digits of its md5 modulo DIMENSIONS, its sign is plus
    if the ninth digit is below 8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            terms = batch.column(1)
            coded = terms.flatten().dictionary_encode()
            places = np.array([_place(x) for x in coded.dictionary.to_pylist()], np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
            owner = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()[: len(batch) + 1]))
            rows = np.bincount(owner * DIMENSIONS + places[:, 0], places[:, 1], len(batch) * DIMENSIONS)
            ends = pa.array(np.arange(len(batch) + 1) * DIMENSIONS, pa.int32())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(rows))], [id_col, out])

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias(id_col), tokens(text)).mapInArrow(run, f"`{id_col}` long, `{out}` array<double>")


def coverage(question: Column, content: Column) -> Column:
    """Share of the question's distinct tokens that the content holds; 0 for a question without tokens."""
    asked = F.array_distinct(tokens(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(content))) / F.size(asked)).otherwise(0.0)


def expand(question: Column) -> Column:
    """Two reformulations: the first and the second half of the question's tokens."""
    own = tokens(question)
    half = F.ceil(F.size(own) / 2).cast("int")
    return F.when(F.size(own) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(F.slice(own, 1, half), " "), F.array_join(F.slice(own, half + 1, F.size(own)), " ")))


def judge(question: Column, preview: Column, threshold: float = 0.5) -> Column:
    """YES if the preview covers enough of the question, else NO."""
    return F.when(coverage(question, preview) >= threshold, "YES").otherwise("NO")


def best_line(question: Column, content: Column) -> Column:
    """The line of the content that covers most of the question, the first of equals: an extractive answer."""
    asked = F.array_distinct(tokens(question))
    scored = F.transform(F.split(content, "\n"), lambda line, i: F.struct((-F.size(F.array_intersect(asked, tokens(line)))).alias("less"), i.alias("i"), line.alias("line")))
    return F.array_min(scored)["line"]
