"""Fusion, merges, BM25 and dense search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dense, ranking, retrieve, sparse


def lists(spark, *own):
    return spark.createDataFrame([(1, n, r, k) for n, keys in enumerate(own) for r, k in enumerate(keys, 1)], "qid long, list_no int, rank int, key string")


def fused(spark, *own):
    return [(r.key, r.fused_score) for r in ranking.fuse(lists(spark, *own), ["qid"], ["key"]).orderBy("fused_rank").collect()]


def test_fusion(spark):
    assert [k for k, _ in fused(spark, "abc", "cab")] == ["a", "c", "b"]
    assert fused(spark, "a", "a", "a", "b", "c")[0] == ("a", pytest.approx(3 / 61, abs=1e-8))
    assert [k for k, _ in fused(spark, "a", "b", "")] == ["a", "b"]
    assert fused(spark, "aa")[0][1] == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    assert ranking.fuse(lists(spark), ["qid"], ["key"]).count() == 0


def test_expansions(spark):
    rows = spark.createDataFrame([(1, "How?", [" how? ", "b", "", None, "B", "c"]), (2, "x", None)], "qid long, question string, generated array<string>")
    assert [(r.qid, r.variant, r.query) for r in ranking.expansions(rows).orderBy("qid", "variant").collect()] == [(1, 0, "How?"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")]


def test_merge_prioritized(spark):
    a = spark.createDataFrame([(1, "p", 1), (1, "q", 2)], "qid long, key string, rank int")
    b = spark.createDataFrame([(1, "q", 1), (1, "r", 2), (1, "s", 3)], "qid long, key string, rank int")
    assert [r.key for r in ranking.merge_prioritized(a, b, ["qid"], ["key"], 3).orderBy("rank").collect()] == ["p", "q", "r"]


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def found(spark, docs, query):
    asked = spark.createDataFrame([(1, query)], "qid long, query string")
    return [r.doc_id for r in sparse.bm25(docs, asked).orderBy("rank").collect()]


def test_bm25(spark, tmp_path):
    docs = corpus(spark, "def login(user): check password", "def add(a, b): return a + b", "def fetch_user(id): pass", None)
    assert found(spark, docs, "login password")[0] == 0
    assert found(spark, docs, "fetch_user")[0] == 2
    assert found(spark, docs, "") == [] and found(spark, docs, "unknown") == []
    assert found(spark, corpus(spark, "only one"), "only") == []  # its idf is negative
    index = sparse.SparseIndex.build(docs)
    stored = sparse.SparseIndex.write(str(tmp_path / "index"), sparse.postings_of(docs), docs)
    asked = spark.createDataFrame([(1, "login password password")], "qid long, query string")
    assert stored.search(asked).collect() == index.search(asked).collect() != []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_recall_of_the_defaults(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    asked = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact, near = ({(r.qid, r.vec_id) for r in f(asked, table, 20).collect()} for f in (dense.cosine_top, dense.approximate_top))
    assert len(exact & near) >= 0.9 * len(exact)


def test_documents_are_scored_where_they_lie(spark, tmp_path):
    """A document's postings are one row, made and read without a shuffle; of a task k rows a query go on."""
    docs = corpus(spark, *(f"common w{i % 7} " + "word " * (i % 5) for i in range(300))).repartition(2)
    plan = sparse.counts_of(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index = sparse.SparseIndex.write(str(tmp_path / "index"), sparse.counts_of(docs), docs)
    assert index.postings.count() == 300
    asked = spark.createDataFrame([(1, "word w3"), (2, "w1 word w1")], "qid long, query string")
    rows = asked.select("qid", F.explode(F.split("query", " ")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    assert index._scored(rows.collect(), rows.schema, 5, "qid").count() <= 5 * 2 * index.postings.rdd.getNumPartitions()


def test_repeated_ids(spark, monkeypatch):
    """Both layouts of postings, both ways of search and the SQL agree, also where ids repeat or are null."""
    import duckdb

    from corvane.plans.oracles import ORACLES

    rows = [(i % 40 if i % 9 else None, f"w{i % 7} w{i % 11} " + "word " * (i % 3) + "x" * (i % 2)) for i in range(120)] + [(7, None), (8, ""), (500, "w1 w2"), (501, "w2 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "word xx w3"), (3, "unknown"), (4, "")], "qid long, query string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [tuple(r) for r in asked.collect()])
    plain = lambda own: sorted((tuple(r) for r in own), key=repr)
    want = plain(con.sql(f"SELECT qid, doc_id, score, rank FROM ({ORACLES['bm25_topk']})").fetchall())
    shown = lambda index: plain(index.search(asked).select("qid", "doc_id", "score", "rank").collect())
    whole, single = sparse.SparseIndex.build(docs), sparse.SparseIndex.of(sparse.postings_of(docs), docs)
    assert want and shown(whole) == want and shown(single) == want
    assert plain(sparse.bm25(docs, asked).select("qid", "doc_id", "score", "rank").collect()) == want
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 1)
    assert shown(whole) == want


def test_many_queries_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 8)))], "vec_id long, embedding array<double>")
    asked = table.withColumnRenamed("vec_id", "qid")
    sent = sorted(map(tuple, dense.cosine_top(asked, table, 5).collect()))
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 10)
    assert sorted(map(tuple, dense.cosine_top(asked, table, 5).collect())) == sent


def test_dense(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, None)], "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    exact = {(r.qid, r.vec_id) for r in dense.cosine_top(asked, table, 10).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 400, 20) for i in np.argsort(-np.round(unit @ unit[q], 6), kind="stable")[:10]}
    assert exact == want
    near = {(r.qid, r.vec_id) for r in dense.approximate_top(asked, table, 10, tables=24, planes=4).collect()}
    assert len(near & exact) / len(exact) >= 0.9


@pytest.fixture(scope="module")
def code(spark):
    rows = [(0, "src/auth/login.py", 0, 5, "def login(user, password): check credentials of user"), (1, "src/math.py", 0, 5, "def add(a, b): return sum"), (2, "src/auth/encoding.py", 3, 9, "def encode(text): utf8 bytes"), (3, "src/coding.py", 0, 4, "huffman tree"), (4, "src/coding.py", 10, 14, "arithmetic coder"), (5, "lib/parse.py", 0, 3, "async def parse(stream): tokens")]
    return spark.createDataFrame([(*r, r[1]) for r in rows], "chunk_no long, file_path string, start_line int, end_line int, content string, context_prefix string")


def test_retrieve(spark, code):
    asked = spark.createDataFrame([(1, "explain coding.py"), (2, "where are user credentials checked"), (3, "")], "qid long, question string")
    rows = retrieve.retrieve(asked, code, top_k=3).orderBy("qid", "rank").collect()
    named = [r for r in rows if r.qid == 1]
    assert [(r.chunk_no, r.src) for r in named[:2]] == [(3, 0), (4, 0)] and named[0].fused_score is None
    assert next(r.chunk_no for r in rows if r.qid == 2) == 0
    assert not [r for r in rows if r.qid == 3]


def test_corrective(spark, code):
    asked = spark.createDataFrame([(1, "login user password"), (2, "zebra quagga okapi parse")], "qid long, question string")
    rows = retrieve.corrective(asked, code, top_k=2).collect()
    assert {r.attempt for r in rows if r.qid == 1} == {0} and {r.attempt for r in rows if r.qid == 2} == {1}


def test_texts_stay_where_they_are_read(spark, code):
    """Few results are sent to the chunks; no join moves the texts."""
    results = spark.createDataFrame([(1, 1, 0), (1, 2, 3)], "qid long, rank int, chunk_no long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieve.context(results, code)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_answers_and_events(spark, code):
    asked = spark.createDataFrame([(1, "login password"), (2, "nothing")], "qid long, question string")
    found = retrieve.retrieve(asked.where("qid = 1"), code, top_k=1)
    made = {r.qid: r for r in retrieve.answers(asked, found, code).collect()}
    assert "login" in made[1].answer and made[1].citations[0].line == 1 and made[2].answer == "" and made[2].citations == []
    events = retrieve.response_events(retrieve.answers(asked, found, code).select(F.col("qid").alias("request_id"), F.lit("s").alias("session_id"), "answer", "citations", F.array().alias("sources"))).orderBy("request_id", "seq").collect()
    assert [e.event for e in events] == ["session_id", "answer_chunk", "citations", "sources", "done"] + ["session_id", "citations", "sources", "done"]
