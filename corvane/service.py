"""Repositories from registration to answers, as functions over one store of tables; no server."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import slashed
from .operators import chunk, delta, retrieve, sparse
from .operators.cache import expiring, query_vectors
from .schemas import CHUNKS, REPOS
from .sources.files import code_files
from .sources.tables import Store, cache_key, chunk_id, live

# How often a failed index run is tried again, and seconds before that.
RETRIES, RETRY_SECONDS = 3, 10

SCHEMAS = {
    "repos": REPOS,
    "files": "file_path string, digest string",
    "chunks": f"chunk_no long, {CHUNKS}",
    "postings": "chunk_no long, dl long, term string, f long",
    "terms": "term string, df long, idf double",
    "totals": "ndocs long, avgdl double",
    "vectors": "chunk_no long, vector array<double>",
    "results": "rank int, file_path string, start_line int, end_line int, expires_at timestamp",
    "query_vectors": "digest string, vector array<double>, expires_at timestamp",
}


class NotFound(LookupError):
    """There is no such repository."""


class NotReady(RuntimeError):
    """The repository's index isn't ready."""


class Service:
    """Tables in a store at ``root``, a part for each repository: its row, digests, chunks, sparse index and vectors; and a part for each cached result.

    An index run turns all tables of its repository in one commit, so a question sees chunks and
    indexes that belong together.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def table(self, name: str, *parts: str) -> DataFrame:
        return self.store.read(name, SCHEMAS[name], list(parts) or None)

    def add_repo(self, url: str) -> str:
        """Registers a URL; a failed repository starts anew, a known one stays. Returns its id."""
        base = self.store.version()
        asked = self.spark.createDataFrame([(url,)], "url string").select(F.substring(F.sha2("url", 256), 1, 32).alias("repo_id"), "url")
        repo_id = asked.first().repo_id
        after = delta.upsert_repos(self.table("repos", repo_id), asked).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
        self.store.commit({("repos", repo_id): after}, base)
        return repo_id

    def _row(self, repo_id: str):
        row = self.table("repos", repo_id).first() if repo_id in self.store.state().get("repos", {}) else None
        if row is None:
            raise NotFound(repo_id)
        return row

    def repo_status(self, repo_id: str) -> str:
        return self._row(repo_id).status

    def first_ready(self) -> str | None:
        row = self.table("repos").where("status = 'ready'").orderBy("created_at", "repo_id").first()
        return row.repo_id if row else None

    def repo_files(self, repo_id: str) -> DataFrame:
        """Distinct indexed paths in order."""
        return self.table("chunks", repo_id).where("file_path <> ''").select(slashed(F.col("file_path")).alias("file_path")).distinct().orderBy("file_path")

    def repo_file_count(self, repo_id: str) -> int:
        return self.repo_files(repo_id).count()

    def orphans(self) -> DataFrame:
        """(repo_id, chunks) of chunks whose repository isn't registered; empty as long as all writes go through this class."""
        state = self.store.state()
        gone = sorted(state.get("chunks", {}).keys() - state.get("repos", {}).keys())
        rows = [self.table("chunks", x).agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(x).alias("repo_id"), "chunks") for x in gone]
        none = self.spark.createDataFrame([], "repo_id string, chunks long")
        for x in rows:
            none = none.unionByName(x)
        return none

    def _with(self, repo_id: str, **values) -> DataFrame:
        return self.table("repos", repo_id).withColumns({k: F.lit(v) for k, v in values.items()}).select(*[F.col(f.name).cast(f.dataType) for f in self.table("repos").schema])

    def _cached(self, repo_id: str) -> dict[tuple[str, str], None]:
        return {("results", part): None for part in self.store.state().get("results", {}) if part.startswith(f"{repo_id}/")}

    def invalidate(self, repo_id: str) -> int:
        """Forgets a repository's cached results; how many there were."""
        gone = self._cached(repo_id)
        if gone:
            self.store.commit(gone)
        return len(gone)

    def reindex(self, repo_id: str) -> None:
        """Forgets all that is indexed, chunks too, so that the next index run takes all files as new."""
        self._row(repo_id)
        forgotten = {(x, repo_id): None for x in ("files", "chunks", "postings", "terms", "totals", "vectors")}
        self.store.commit(self._cached(repo_id) | forgotten | {("repos", repo_id): self._with(repo_id, status="pending", last_commit_sha=None)})

    def index(self, repo_id: str, directory: str, commit: str | None = None, progress: Callable[[str, int, int], None] | None = None) -> int:
        """Brings the tables up to the files in a directory; only what changed is chunked, embedded and tokenized. Returns the number of changed files.

        progress is called with a phase and counts (done, total); what it raises is ignored. A
        failure leaves the tables as they were, and the status error.
        """

        def tell(phase: str, done: int = 0, total: int = 0) -> None:
            try:
                if progress is not None:
                    progress(phase, done, total)
            except Exception:
                pass  # telling must not break the run

        self._row(repo_id)
        base = self.store.commit({("repos", repo_id): self._with(repo_id, status="indexing")})
        try:
            tell("diffing")
            files = code_files(self.spark, directory)
            folder, changed = self.store.stage("files", delta.changes(self.table("files", repo_id), files.select("file_path", "digest")))
            count = changed.count()
            turned: dict[tuple[str, str], DataFrame | str | None] = {("repos", repo_id): self._with(repo_id, status="ready", last_commit_sha=commit, indexed_at=datetime.now(timezone.utc))}
            if count:
                tell("chunking", 0, count)
                fresh = chunk.chunk_files(files.join(changed.where("change <> 'deleted'"), "file_path", "left_semi")).withColumn("chunk_no", chunk_id())
                _, fresh = self.store.stage("chunks", fresh)
                old = self.table("chunks", repo_id)
                gone = old.join(changed, "file_path", "left_semi").select("chunk_no").distinct()
                merged, chunks = self.store.stage("chunks", delta.merge(old, changed, fresh, ["file_path"]).select(*old.columns))
                tell("embedding", 0, total := fresh.count())

                def kept(name: str, made: DataFrame) -> DataFrame:
                    held = self.table(name, repo_id)
                    return held.join(gone, "chunk_no", "left_anti").unionByName(made.select(*held.columns))

                vectors, _ = self.store.stage("vectors", kept("vectors", retrieve.vectors_of(fresh)))
                tell("embedding", total, total)
                tell("upserting")
                written, postings = self.store.stage("postings", kept("postings", sparse.postings_of(retrieve.sparse_texts(fresh), "chunk_no")), "term")
                index = sparse.SparseIndex.of(postings, chunks, "chunk_no")
                turned |= self._cached(repo_id)
                turned |= {("files", repo_id): files.select("file_path", "digest"), ("chunks", repo_id): merged, ("vectors", repo_id): vectors, ("postings", repo_id): written}
                turned |= {("terms", repo_id): self.store.stage("terms", index.terms, "term")[0], ("totals", repo_id): index.totals}
            self.store.commit(turned, base)
            tell("done")
            return count
        except Exception:
            self.store.commit({("repos", repo_id): self._with(repo_id, status="error")})
            tell("error")
            raise

    def index_with_retries(self, *args, pause: Callable[[float], None] = time.sleep, **kwargs) -> int:
        """index, tried again RETRIES times after a failure."""
        for left in range(RETRIES, -1, -1):
            try:
                return self.index(*args, **kwargs)
            except NotFound:
                raise
            except Exception:
                if not left:
                    raise
                pause(RETRY_SECONDS)
        raise AssertionError

    def stored(self, repo_id: str) -> retrieve.Stored:
        index = sparse.SparseIndex(*(self.table(x, repo_id) for x in ("postings", "terms", "totals")), "chunk_no")
        return retrieve.Stored(index, self.table("vectors", repo_id))

    def query(self, repo_id: str, question: str, **settings) -> DataFrame:
        """Ranked chunks for a question, from the cached results if the same was asked within the hour; else from the stored indexes."""
        if self.repo_status(repo_id) != "ready":
            raise NotReady(repo_id)
        key = self.spark.range(1).select(cache_key(F.lit(repo_id), F.lit(question), sorted(settings.items()))).first()[0]
        part = f"{repo_id}/{key}"
        held = live(self.table("results", part), F.current_timestamp()) if part in self.store.state().get("results", {}) else None
        if held is None or held.isEmpty():
            asked = self.spark.createDataFrame([(1, question)], "qid long, question string")
            found = retrieve.corrective(asked, self.table("chunks", repo_id), stored=self.stored(repo_id), **settings)
            rows = found.select(F.col("rank").cast("int").alias("rank"), "file_path", "start_line", "end_line")
            folder, held = self.store.stage("results", expiring(rows, F.current_timestamp()))
            self.store.commit({("results", part): folder})
        return held.select("rank", "file_path", "start_line", "end_line").orderBy("rank")

    def embed_queries(self, queries: DataFrame) -> DataFrame:
        """(qid, vector) of (qid, query); vectors are kept for a day."""
        base = self.store.version()
        now = F.current_timestamp()
        vectors, fresh = query_vectors(queries, self.table("query_vectors"), now)
        folder, made = self.store.stage("query_vectors", fresh)
        if made.isEmpty():
            return vectors
        self.store.commit({("query_vectors", folder): folder}, base)
        return query_vectors(queries, self.table("query_vectors"), now)[0]
