"""File trees, chunks, deltas, snapshots, evaluation."""

import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import chunk, delta, evaluate
from corvane.sources.files import code_files
from corvane.sources.tables import Conflict, Snapshots, Store, json_results, modified_at, write_json

PYTHON = "import os\n\nclass A:\n    def f(self):\n        x = 1\n        return x\n\n    def g(self): return 2\n\n\nasync def h():\n    def inner():\n        pass\n        pass\n    return inner\n"
SCRIPT = "export class B {\n  run(a) {\n    if (a) {\n      return '}';\n    }\n  }\n}\nconst f = (x) => {\n  return x;\n};\n"


def test_files_are_chunked_in_small_runs(spark):
    """A worker takes a few files at a time from batches of 4 MB at most; the chunks are those of each file alone."""
    from corvane.operators import batches

    batch = batches.pa.record_batch([["a"] * 700, ["x" * 5000] * 699 + ["y" * 3_000_000]], ["file_path", "source"])
    parts = list(batches.runs([batch], 1, chunk.RUN_BYTES, chunk.RUN_FILES))
    assert sum(map(len, parts)) == 700 and max(map(len, parts)) <= chunk.RUN_FILES and len(parts[-1]) == 1
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    files = spark.createDataFrame([(f"{i}.py", PYTHON, "python") for i in range(600)] + [(None, PYTHON, "python"), ("x.py", None, "python")], "file_path string, source string, language string").coalesce(1)
    found = chunk.chunk_files(files)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20
    rows = found.groupBy("file_path").count().collect()
    assert len(rows) == 601 and {r["count"] for r in rows} == {3}


def test_chunk_python():
    rows = chunk.chunk_source("a.py", PYTHON, "python")
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in rows] == [("class", "A", None, 2, 7), ("function", "f", "A", 3, 5), ("function", "h", None, 10, 14)]
    assert chunk.chunk_source("b.py", "x = 1\n", "python")[0][2:7] == ("module", "module", None, 0, 1)
    assert chunk.chunk_source("c.py", " \n", "python") == []
    assert chunk.chunk_source("d.py", "def (:\n", "python")[0][2] == "module"


def test_chunk_others():
    rows = chunk.chunk_source("a.js", SCRIPT, "javascript")
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in rows] == [("function", None, None, 0, 6), ("function", "f", None, 7, 9)]  # an export is one chunk
    rows = chunk.chunk_source("a.ts", SCRIPT.replace("export ", "") + "export const settings = {\n  a: 1,\n};\nexport { x } from 'y';\n", "typescript")
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in rows] == [("class", "B", None, 0, 6), ("function", "run", "B", 1, 5), ("function", "f", None, 7, 9), ("function", None, None, 10, 12)]
    assert rows[1][7].startswith("run(a) {\n    if")
    java = chunk.chunk_source("A.java", "public enum E {\n  ONE,\n  TWO;\n  int f() {\n    int a = 1;\n    return a;\n  }\n}\npublic class C {\n  public int g() {\n    int a = 1;\n    return a;\n  }\n}\n", "java")
    assert [(r[2], r[3], r[4]) for r in java] == [("function", "E", None), ("class", "C", None), ("function", "g", "C")]  # an enum is not entered
    go = chunk.chunk_source("a.go", "package x\nfunc (r *T) Do(a int) int {\n  return a\n}\ntype T struct {\n  a int\n}\n", "go")
    assert [(r[3], r[5], r[6]) for r in go] == [("Do", 1, 3), ("T", 4, 6)]
    ruby = chunk.chunk_source("a.rb", "module M\n  class C\n    def f\n      if x\n        1\n      end\n    end\n  end\nend\n", "ruby")
    assert [(r[2], r[3], r[4]) for r in ruby] == [("function", "M", None)]  # a module is not entered
    ruby = chunk.chunk_source("a.rb", "class C\n  def f\n    if x\n      1\n    end\n  end\nend\n", "ruby")
    assert [(r[2], r[3], r[4]) for r in ruby] == [("class", "C", None), ("function", "f", "C")]


def windows(n):
    starts = [0]
    while starts[-1] + 60 < n:
        starts.append(starts[-1] + 45)
    return starts


def test_window_split(spark):
    sizes = [2, 3, 80, 81, 105, 106, 2999]
    rows = [("f", "python", "function", "n" if n % 2 else None, 10, 10 + n - 1, "\n".join(map(str, range(n))), "f") for n in sizes]
    from corvane.schemas import CHUNKS

    cut = chunk.window_split(spark.createDataFrame(rows, CHUNKS)).collect()
    want = []
    for n in sizes:
        parts = windows(n) if n > 80 else [None]
        for i, s in enumerate(parts):
            label = f"part {i + 1}/{len(parts)}"
            name = "n" if n % 2 else None
            want.append((10, 10 + n - 1, "f", name) if s is None else (10 + s, 10 + min(s + 60, n) - 1, f"f > {label}", f"{name} ({label})" if name else label))
    assert sorted(map(repr, want)) == sorted(repr((r.start_line, r.end_line, r.context_prefix, r.name)) for r in cut)


def test_code_files(spark, tmp_path):
    for path, content in {"src/a.py": PYTHON.encode(), "src/B.JS": SCRIPT.encode(), "build/c.py": b"x", "d.md": b"x", "big.py": b"x" * 500_001, "full.py": b"#" * 500_000, "bad.c": b"int x; // \xff\n"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_bytes(content)
    files = code_files(spark, str(tmp_path))
    rows = {r.file_path: r for r in files.collect()}
    assert {k: r.language for k, r in rows.items()} == {"src/a.py": "python", "src/B.JS": "javascript", "full.py": "python", "bad.c": "c"}
    assert "\ufffd" in rows["bad.c"].source
    chunks = chunk.chunk_files(files.where("file_path <> 'full.py'")).collect()
    assert ("src/a.py > A > f", "function") in {(c.context_prefix, c.chunk_type) for c in chunks}


def test_delta_and_snapshots(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "file_path string, digest string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "file_path string, digest string")
    assert {(r.file_path, r.change) for r in delta.changes(old, new).collect()} == {("a", "deleted"), ("b", "changed"), ("d", "added")}
    table = Snapshots(spark, str(tmp_path / "files"), "file_path string, digest string")
    assert table.read().count() == 0
    table.append(old)
    touched = delta.changes(table.read(), new)
    table.replace(delta.merge(table.read(), touched, new.join(touched, "file_path", "left_semi"), ["file_path"]))
    assert {tuple(r) for r in table.read().collect()} == {("b", "3"), ("c", None), ("d", "4")}
    table.delete(F.col("file_path") == "b")
    table.delete_keys(spark.createDataFrame([("d",)], "file_path string"), ["file_path"])
    assert [tuple(r) for r in table.read().collect()] == [("c", None)]


def test_store(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "s")), "k string, v long"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    assert store.version() == 0 and store.read("t", schema).count() == 0
    assert store.commit({("t", "a"): rows(("a", 1)), ("t", "b"): rows(("b", 1)), ("u", ""): rows(("u", 1))}) == 1
    base, kept = store.version(), store.state()["t"]["b"]
    store.commit({("t", "a"): rows(("a", 2)), ("u", ""): None}, base)  # other parts keep their folders
    assert store.state()["t"]["b"] == kept and store.read("u", schema).count() == 0
    assert sorted(map(tuple, store.read("t", schema).collect())) == [("a", 2), ("b", 1)] and [tuple(r) for r in store.read("t", schema, ["b"]).collect()] == [("b", 1)]
    with pytest.raises(Conflict):
        store.commit({("t", "a"): rows(("a", 3))}, base)
    store.commit({("t", "b"): rows(("b", 3))}, base)  # nobody has changed that one since
    assert sorted(map(tuple, store.read("t", schema, version=1).collect())) == [("a", 1), ("b", 1)]
    assert store.clean(keep=1) == 4 and sorted(map(tuple, store.read("t", schema).collect())) == [("a", 2), ("b", 3)]


def test_results_files(spark, tmp_path):
    path = str(tmp_path / "r" / "results.json")
    assert modified_at(spark, path) is None
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "results.json").write_text("{}")
    os.utime(path, (0, 1_700_000_000.25))
    assert modified_at(spark, path) == "2023-11-14T22:13:20.250000+00:00"
    write_json(spark.createDataFrame([("q", 0.5)], "question string, score double"), str(tmp_path / "out"))
    assert json_results(spark, str(tmp_path / "out"), "question string, score double").first() == ("q", 0.5)


def test_evaluation_runs(spark):
    tests = evaluate.samples(spark, [("how is the total added up", "the total is added up"), ("who greets", "hello")])
    chunks = spark.createDataFrame([(1, "a.py", 0, 2, "def total(): the total is added up", "a.py"), (2, "b.py", 0, 2, "def greet(): hello who greets", "b.py")], "chunk_no long, file_path string, start_line int, end_line int, content string, context_prefix string")
    rows = {r.case_no: r for r in evaluate.run(tests, chunks, strategy="single").collect()}
    assert rows[0].context_recall == 1.0 and rows[1].context_recall == 1.0 and rows[0].faithfulness == 1.0 and rows[0].contexts[0].startswith("def total")
    got = evaluate.ablation(tests, chunks).collect()
    assert {(r.strategy, r.metric, r.n) for r in got} == {(s, m, 2) for s in ("single", "fusion") for m in ("faithfulness", "context_recall")}
    shown = evaluate.dashboard(evaluate.passed(evaluate.run(tests, chunks, strategy="single")), [("answer_length", True)]).orderBy("place").collect()
    assert [r.case_no for r in shown] == [1, 0] and shown[0].context_recall == "100.0%"
    with pytest.raises(ValueError):
        evaluate.dashboard(evaluate.passed(evaluate.run(tests, chunks)), [("colour", True)])


def test_upsert_repos(spark):
    repos = spark.createDataFrame([("1", "u1", "error", "s1"), ("2", "u2", "ready", "s2")], "repo_id string, url string, status string, last_commit_sha string").withColumns({"indexed_at": F.lit(None).cast("timestamp"), "created_at": F.lit(None).cast("timestamp")})
    asked = spark.createDataFrame([("9", "u1"), ("8", "u2"), ("7", "u3"), ("6", "u3")], "repo_id string, url string")
    assert {tuple(r)[:4] for r in delta.upsert_repos(repos, asked).collect()} == {("1", "u1", "pending", None), ("2", "u2", "ready", "s2"), ("6", "u3", "pending", None)}


def test_evaluation(spark, tmp_path):
    scores = spark.createDataFrame([(0, 0.8, 0.9, 0.76), (1, 0.75, 1.0, 1.0), (2, float("nan"), None, 0.5)], "case_no int, faithfulness double, answer_relevancy double, context_recall double")
    assert tuple(evaluate.averages(scores).first()) == (0.775, 0.95, (0.76 + 1.0 + 0.5) / 3)
    tests = spark.createDataFrame([(i,) for i in range(4)], "case_no int")
    assert [(r.case_no, r.passed) for r in evaluate.results_view(tests, scores.where("case_no < 2")).orderBy("case_no").collect()] == [(0, True), (1, False), (2, False), (3, False)]
    assert evaluate.column_mean(scores, ["missing", "faithfulness"]).first().scored == 2
    assert evaluate.column_mean(scores, ["missing"]).first().scored == 0
    assert json_results(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert evaluate.next_run_state("idle", "start") == "running" and evaluate.next_run_state("running", "finish") == "completed"
