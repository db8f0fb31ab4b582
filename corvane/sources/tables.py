"""Tables under one log: a commit is one small file that says which folders the tables consist of."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

State = dict[str, dict[str, str]]


class Conflict(RuntimeError):
    """Another commit has changed the same part of a table meanwhile."""


class Store:
    """Tables below ``root``, each of parts (one folder a part, named by a text such as a repository's id).

    A commit names the folders of all tables and appears at once, by a rename that fails if there
    is such a commit: readers see all of a commit or nothing of it, and of two writers of the same
    part one gets Conflict. Folders are never written twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")

    def _fs(self):
        return self._path("_log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        fs, path = self._fs(), self._path("_log")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(x) for x in names if x.isdigit())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._commits(), default=0)

    def state(self, version: int | None = None) -> State:
        """Table -> part -> folder."""
        version = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/_log/{version:020d}", wholetext=True).first()[0]) if version else {}

    def read(self, table: str, schema: str, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """A table, or these parts of it; without a folder an empty one of the schema."""
        held = self.state(version).get(table, {})
        folders = [f"{self.root}/{x}" for p, x in sorted(held.items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stage(self, table: str, df: DataFrame, sort: str | None = None) -> tuple[str, DataFrame]:
        """Writes a folder that no commit names yet; its name, for commit, and what is in it. sort: rows of like values come together, so that readers skip the others."""
        folder = f"{table}/{uuid.uuid4().hex}"
        (df.sort(sort) if sort else df).write.parquet(f"{self.root}/{folder}")
        return folder, self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")

    def commit(self, changes: dict[tuple[str, str], DataFrame | str | None], base: int | None = None) -> int:
        """Sets parts, (table, part) -> rows, staged folder or None (no such part any more), as one commit.

        base: the version from which the changes were made; parts that others have changed since
        raise Conflict.
        """
        base = self.version() if base is None else base
        held = self.state(base)
        folders = {k: self.stage(k[0], x)[0] if isinstance(x, DataFrame) else x for k, x in changes.items()}
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("_log").toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            now = self.version()
            state = self.state(now)
            for (table, part), folder in folders.items():
                if state.get(table, {}).get(part) != held.get(table, {}).get(part):
                    raise Conflict(f"{table}/{part}")
                own = state.setdefault(table, {})
                own.pop(part, None)
                if folder is not None:
                    own[part] = folder
            made = self._path(f"_log/_{uuid.uuid4().hex}")
            out = self._fs().create(made, False)
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
            try:
                context.rename(made, self._path(f"_log/{now + 1:020d}"), options)
                return now + 1
            except Exception as e:
                self._fs().delete(made, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    def clean(self, keep: int = 2) -> int:
        """Removes the commits before the last ``keep``, and folders that none of those names; returns the number of folders. Not while others write."""
        fs, commits = self._fs(), self._commits()
        named = {x for v in commits[-keep:] for parts in self.state(v).values() for x in parts.values()}
        gone = 0
        for table in fs.listStatus(self._path("")) if commits else []:
            name = table.getPath().getName()
            for folder in fs.listStatus(table.getPath()) if name != "_log" else []:
                if f"{name}/{folder.getPath().getName()}" not in named:
                    fs.delete(folder.getPath(), True)
                    gone += 1
        for v in commits[:-keep]:
            fs.delete(self._path(f"_log/{v:020d}"), False)
        return gone


@dataclass
class Snapshots:
    """A table in a store of its own. Readers see the old version or the new one, never a mixture."""

    spark: SparkSession
    root: str
    schema: str

    def __post_init__(self):
        self.store = Store(self.spark, self.root)

    def read(self) -> DataFrame:
        return self.store.read("rows", self.schema)

    def replace(self, df: DataFrame) -> None:
        base = self.store.version()
        gone = {("rows", part): None for part in self.store.state(base).get("rows", {})}
        self.store.commit(gone | {("rows", ""): df.select(*self.read().columns)}, base)

    def delete(self, condition) -> None:
        self.replace(self.read().where(~F.coalesce(condition, F.lit(False))))

    def delete_keys(self, keys: DataFrame, on: list[str]) -> None:
        self.replace(self.read().join(keys.select(*on).distinct(), on, "left_anti"))

    def append(self, df: DataFrame) -> None:
        """Adds a folder; what is there stays as it is."""
        self.store.commit({("rows", uuid.uuid4().hex): df.select(*self.read().columns)})


def live(cache: DataFrame, now) -> DataFrame:
    """The entries (with expires_at) that have not expired."""
    return cache.where(F.col("expires_at") > now)


def cache_key(repo_id, question, *settings):
    """A digest of all that determines a result, fields apart."""
    return F.sha2(F.concat_ws("\u0000", repo_id, question, *[F.lit(str(x)) for x in settings]), 256)


def chunk_id():
    """A number of the columns that tell chunks apart, so that writing again gives the same ids."""
    return F.xxhash64("file_path", "start_line", "end_line", "chunk_type", "name", "content")


def json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of results; an empty table of the schema if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).json(path, multiLine=True) if there else spark.createDataFrame([], schema)


def modified_at(spark: SparkSession, path: str) -> str | None:
    """When a file was last changed, as ISO 8601 in UTC with microseconds; None without such a file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    at = spark.range(1).select(F.timestamp_millis(F.lit(fs.getFileStatus(where).getModificationTime())).alias("t"))
    stamp = F.to_utc_timestamp("t", F.current_timezone())
    return at.select(F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))).first()[0]


def write_json(df: DataFrame, path: str) -> None:
    """Results, a few rows, as one JSON file's folder, one object a line."""
    df.coalesce(1).write.mode("overwrite").json(path)
