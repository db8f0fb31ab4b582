"""Streams end where batches end."""

import json

from pyspark.sql import functions as F

from corvane.functions.decode import answer_so_far, decoded_further
from corvane.sources.tables import Store
from corvane.streaming import conversation, progress, pushes


def drained(df, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return df.sparkSession.table(name).collect()


def streamed(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.json(path)
    return spark.readStream.schema(schema).json(path)


def test_progress(spark, tmp_path):
    schema = "repo_id string, phase string, current long, total long, ts long"
    rows = [("r", "cloning", 1, 2, 1), ("r", "cloning", 1, 2, 1), ("r", "done", 1, 1, 3), ("r", "cloning", 1, 2, 4), ("q", "chunking", 1, 4, 2)]
    events = progress.with_percent(streamed(spark, rows, schema, str(tmp_path / "p")))
    got = drained(progress.followed(events.select("repo_id", "phase", "percent", "ts"), live=None), "append", "followed")
    assert sorted(tuple(r) for r in got) == [("q", "chunking", 20, 2), ("r", "cloning", 5, 1), ("r", "done", 100, 3)]
    late = drained(progress.followed(events.select("repo_id", "phase", "percent", "ts"), since=2, live=None), "append", "late")
    assert sorted(tuple(r) for r in late) == [("q", "chunking", 20, 2), ("r", "cloning", 5, 1), ("r", "done", 100, 3)]
    last = drained(progress.latest(events), "complete", "latest")
    assert {(r.repo_id, r.ts) for r in last} == {("r", 4), ("q", 2)}


def test_replay(spark):
    rows = [("r", "cloning", 5, 1), ("r", "cloning", 7, 5), ("r", "chunking", 20, 6), ("r", "chunking", 20, 6), ("r", "done", 100, 8), ("r", "cloning", 1, 9), ("q", "error", 0, 2), ("q", "cloning", 1, 7), ("p", "cloning", 1, -50)]
    events = spark.createDataFrame(rows, "repo_id string, phase string, percent int, ts long")
    got = sorted((r.repo_id, r.ts) for r in progress.replayed(events, 5, 10).collect())
    assert got == [("q", 2), ("r", 5), ("r", 6), ("r", 8)]  # q ended before, p's snapshot is too old


def test_publish_and_remember(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    schema = "repo_id string, phase string, percent int, ts long"
    query = progress.publish(streamed(spark, [("r", "cloning", 5, 1), ("r", "done", 100, 3), ("q", "cloning", 1, 2)], schema, str(tmp_path / "e")), store, str(tmp_path / "c1"))
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in store.read("progress", schema).collect()) == [("q", "cloning", 1, 2), ("r", "done", 100, 3)]
    turns = [(s, i, "user", f"{s}{i}") for s, n in (("a", 9), ("b", 2)) for i in range(n)]
    stream = streamed(spark, turns, "session_id string, turn long, role string, text string", str(tmp_path / "h"))
    query = conversation.remember(stream, store, str(tmp_path / "c2"))
    query.processAllAvailable()
    spark.createDataFrame([("b", 2, "user", "b2")], "session_id string, turn long, role string, text string").write.mode("append").json(str(tmp_path / "h"))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.session_id, r.turn) for r in conversation.history(store).collect()) == [("a", i) for i in range(3, 9)] + [("b", i) for i in range(3)]


def test_throttle(spark):
    rows = spark.createDataFrame([("r", i) for i in range(1, 121)], "repo_id string, ts long")
    assert [r.rn for r in progress.throttled(rows, "repo_id", "ts").orderBy("rn").collect()] == list(range(2, 121, 2))


def test_history(spark):
    rows = [("a", i, "user", str(i)) for i in range(7)] + [("b", i, "user", str(i)) for i in range(6)] + [("c", 0, "user", "x")]
    kept = conversation.last_turns(spark.createDataFrame(rows, "session_id string, turn long, role string, text string"))
    assert {(r.session_id, r.n) for r in kept.groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {("a", 6), ("b", 6), ("c", 1)}
    assert kept.where("session_id = 'a'").agg(F.min("turn")).first()[0] == 1


def test_deltas(spark, tmp_path):
    whole = json.dumps({"answer": "one\ntwo é", "citations": []})
    rows = [("r", i, whole[3 * i : 3 * i + 3]) for i in range(len(whole) // 3 + 1)]
    got = drained(conversation.streamed_deltas(streamed(spark, rows, "request_id string, seq long, token string", str(tmp_path / "t")), live=None), "append", "deltas")
    assert "".join(r.delta for r in sorted(got, key=lambda r: r.seq)) == "one\ntwo é"
    texts = conversation.deltas(spark.createDataFrame(rows, "request_id string, seq long, token string")).orderBy("seq").collect()
    assert texts[-1].text == whole and [r.text[r.length :] for r in texts] == [t for _, _, t in rows]


def test_pieces_decode_like_the_whole():
    text = '{"x": 1, "answer" : "a\\n\\u00e9 \\uZZZZb \\q\\"c\\\\ d", "citations": []}'
    whole = answer_so_far(text)
    assert whole == 'a\né ZZZZb q"c\\ d'
    for size in (1, 2, 3, 7, 100):
        rest, begun, ended, out = "", False, False, ""
        for at in range(0, len(text), size):
            if not ended:
                new, rest, begun, ended = decoded_further(rest + text[at : at + size], begun)
                out += new
        assert out == whole and ended


def test_pushes(spark, tmp_path):
    push = lambda ref, branch, url: json.dumps({"ref": ref, "repository": {"default_branch": branch, "clone_url": url}})
    rows = [(push("refs/heads/main", None, "https://h/a.git"),), (push("refs/heads/dev", "main", "https://h/a.git"),), (push("refs/heads/dev", "dev", "https://h/b"),), ("{broken",)]
    repos = spark.createDataFrame([("A", "https://h/a"), ("B", "https://h/b.git")], "repo_id string, url string")
    assert sorted(r.repo_id for r in pushes.pushes(spark.createDataFrame(rows, "payload string"), repos).collect()) == ["A", "B"]
    seen = []
    query = pushes.refresh_on_push(streamed(spark, rows, "payload string", str(tmp_path / "w")), repos, seen.extend, str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert seen == ["A", "B"]
