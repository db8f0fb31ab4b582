"""File trees as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, in_skipped_directory, language

# Fixed value: the largest file that is read.
MOST_BYTES = 500_000


def code_paths(paths: DataFrame, path: str = "file_path", length: str = "length") -> DataFrame:
    """The rows whose path has a language, lies in no skipped directory and whose file isn't too large, with the language."""
    return paths.withColumn("language", language(F.col(path))).where(F.col("language").isNotNull() & (F.col(length) <= MOST_BYTES) & ~in_skipped_directory(F.col(path)))


def code_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, source, language, digest) of the code files below root; paths are relative, bytes that aren't UTF-8 become U+FFFD.

    Extension, directory and size are judged on the listing, before any content is read.
    """
    base = root.rstrip("/") + "/"
    glob = "*{" + ",".join(sorted({f"{x}" for e in LANGUAGES for x in (e, e.upper(), e.capitalize())})) + "}"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^.*?" + re.escape(base), "")
    kept = code_paths(listed.where(F.col("length") <= MOST_BYTES).withColumn("file_path", relative))
    return kept.select("file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("source"), "language", F.sha2("content", 256).alias("digest"))
