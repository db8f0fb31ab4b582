"""A repository from registration to answers."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import cache
from corvane.service import NotFound, NotReady, Service


def test_service(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    (code / "login.py").write_text("def login(user, password):\n    check = user.check(password)\n    return check\n")
    (code / "sum.py").write_text("def add(a, b):\n    total = a + b\n    return total\n")
    service = Service(spark, str(tmp_path / "tables"))
    with pytest.raises(NotFound):
        service.repo_status("none")
    repo = service.add_repo("https://h/a")
    assert service.add_repo("https://h/a") == repo and service.repo_status(repo) == "pending"
    with pytest.raises(NotReady):
        service.query(repo, "login")
    assert service.index(repo, str(code), "c1") == 2 and service.index(repo, str(code), "c2") == 0
    assert service.first_ready() == repo
    assert [r.file_path for r in service.repo_files(repo).collect()] == ["login.py", "sum.py"]
    first = service.query(repo, "who checks the password of a user in login.py", top_k=1).collect()
    assert first[0].file_path == "login.py" and service.query(repo, "who checks the password of a user in login.py", top_k=1).collect() == first
    (code / "sum.py").unlink()
    assert service.index(repo, str(code)) == 1 and [r.file_path for r in service.repo_files(repo).collect()] == ["login.py"]
    assert service.invalidate(repo) == 0  # the index run has forgotten them
    again = service.stored(repo)
    assert again.vectors.count() == service.table("chunks", repo).count() == 1 and {r.term for r in again.sparse.terms.collect()} >= {"login", "password"}
    (code / "new.py").write_text("def new(a):\n    b = a\n    return b\n")
    (code / "login.py").unlink()
    service.reindex(repo)
    assert service.repo_status(repo) == "pending" and service.repo_file_count(repo) == 0
    told = []
    assert service.index(repo, str(code), progress=lambda *x: told.append(x)) == 1
    assert [r.file_path for r in service.repo_files(repo).collect()] == ["new.py"]  # what has gone meanwhile is gone
    assert told[0][0] == "diffing" and told[-1][0] == "done" and ("embedding", 1, 1) in told and service.orphans().count() == 0


def test_index_with_retries(spark, tmp_path):
    service, pauses = Service(spark, str(tmp_path / "tables")), []
    repo = service.add_repo("https://h/b")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        service.index_with_retries(repo, str(tmp_path / "nowhere"), pause=pauses.append)
    assert pauses == [10, 10, 10] and service.repo_status(repo) == "error"
    assert service.add_repo("https://h/b") == repo and service.repo_status(repo) == "pending"


def test_stored_indexes_give_what_a_scan_gives(spark, tmp_path):
    from corvane.operators import retrieve, sparse

    chunks = spark.createDataFrame([(i, f"f{i}.py", 0, 3, f"def f{i}(): word{i % 7} and word{i % 5} here", f"f{i}.py") for i in range(40)], "chunk_no long, file_path string, start_line int, end_line int, content string, context_prefix string")
    asked = spark.createDataFrame([((1 << 60) + 1, "where is word3 in f3.py"), (2, "word1 word4")], "qid long, question string")
    stored = retrieve.Stored(sparse.SparseIndex.build(retrieve.sparse_texts(chunks), "chunk_no"), retrieve.vectors_of(chunks))
    scan, index = (sorted(map(tuple, retrieve.retrieve(asked, chunks, stored=x).collect()), key=repr) for x in (None, stored))
    assert scan == index and {r[0] for r in scan} == {(1 << 60) + 1, 2}


def test_query_vectors_are_kept(spark, tmp_path):
    service = Service(spark, str(tmp_path / "tables"))
    asked = spark.createDataFrame([(1, "a b"), (2, "c")], "qid long, query string")
    assert service.embed_queries(asked).count() == 2 and service.store.version() == 1
    assert service.embed_queries(asked).count() == 2 and service.store.version() == 1


def test_query_vectors(spark):
    asked = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b")], "qid long, query string")
    none = spark.createDataFrame([], "digest string, vector array<double>, expires_at timestamp")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    vectors, fresh = cache.query_vectors(asked, none, now)
    assert vectors.count() == 3 and fresh.count() == 2
    again, more = cache.query_vectors(asked, fresh, now)
    assert more.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, vectors.collect()))
    assert cache.query_vectors(asked, fresh, now + F.expr("INTERVAL 2 DAYS"))[1].count() == 2
    kept, gone = cache.invalidated(spark.createDataFrame([("r", 1), ("q", 2), (None, 3)], "repo_id string, x int"), "r")
    assert gone == 1 and kept.count() == 2
