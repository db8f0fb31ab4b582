"""Indexes that are built once for a table and read by every query after that."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.sparse import SparseIndex
from ..sources.shared import shared_dir


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of a table's files: names, sizes and times of change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        x = files.next()
        found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()[:24]


def folder_of(spark: SparkSession, table: str, kind: str, build: Callable[[str], None]) -> str:
    """The shared folder of what ``build`` makes of the table at this path; it is called only if there is none for the table as it is now."""
    jvm = spark._jvm
    path = f"{shared_dir(spark)}/corvane-index/{kind}-{fingerprint(spark, table)}"
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        made = f"{path}-{uuid.uuid4().hex}"
        build(made)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(made), where) and not fs.exists(where):
            raise OSError(f"cannot name {path}")
    return path


def stored_sparse(spark: SparkSession, table: str, kind: str, id_col: str, postings: Callable[[], DataFrame], docs: Callable[[], DataFrame]) -> SparseIndex:
    """Sparse index of a table, from the shared folder."""
    return SparseIndex.read(spark, folder_of(spark, table, f"{kind}-sparse", lambda path: SparseIndex.write(path, postings(), docs(), id_col)), id_col)


def stored_vectors(spark: SparkSession, table: str, kind: str, vectors: Callable[[], DataFrame]) -> DataFrame:
    """Vectors of a table, from the shared folder."""
    return spark.read.parquet(folder_of(spark, table, f"{kind}-dense", lambda path: vectors().write.parquet(path)))
