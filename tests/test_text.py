"""Tokens, paths and payloads against small plain models."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions.decode import answer_prefix, answer_so_far


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}").orderBy("i").select(expression(F.col("x"))).collect()]


def test_tokens(spark):
    found = column(spark, ["def fetch_User(id: int) -> User:", "", "  \n", None, "Ünï_cöde 日本"], X.tokens)
    assert found == [["def", "fetch", "user", "id", "int", "user"], [], [], [], ["ünï", "cöde", "日本"]]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.characters(codec="ascii"), max_size=30), min_size=1, max_size=20))
def test_tokens_like_the_plain_rule(spark, texts):
    assert column(spark, texts, X.tokens) == [[t for t in re.split(r"[\W_]+", x.lower()) if t] for x in texts]


def test_references_and_paths(spark):
    found = column(spark, ["see ./src\\a.py and ../x/B.TSX, coding.pyc no.md c.c", None], X.file_references)
    assert found == [["src/a.py", "x/B.TSX", "c.c"], []]
    match = lambda refs: lambda p: X.path_matches(p, F.array(*map(F.lit, refs)))
    assert column(spark, ["src/coding.py", "src/encoding.py", "coding.py", "a\\coding.py", "Coding.py"], match(["coding.py"])) == [True, False, True, True, False]
    assert column(spark, ["a/b\\c.py"], X.path_suffixes) == [["a/b/c.py", "b/c.py", "c.py"]]
    assert column(spark, ["a.PY", "b/x.tsx", "noext", "dir.py/readme", ".py", None], X.language) == ["python", "typescript", None, None, None, None]
    assert column(spark, ["build/a.py", "src/build.py", "a/.git/x.c", "dist"], X.in_skipped_directory) == [True, False, True, False]


def test_lines_and_percent(spark):
    texts = ["a\nb\n", "a\r\nb\x0cc", "", "\n", "x\u2028y"]
    assert column(spark, texts, X.lines) == [t.splitlines() for t in texts]
    rows = spark.createDataFrame([("cloning", 1, 2), ("embedding", 3, 10), ("done", 5, 5), ("error", 1, 2), ("other", 1, 2), ("upserting", 9, 0), ("chunking", 7, 3)], "phase string, current long, total long")
    assert [r[0] for r in rows.select(X.percent(F.col("phase"), F.col("current"), F.col("total"))).collect()] == [5, 48, 100, 0, 0, 80, 35]
    assert column(spark, ['{"phase": "done"}', '{"phase": "cloning"}', "{broken"], X.is_final) == [True, False, False]
    assert column(spark, [" no\n", "NO.", None, "\u00a0no\u00a0"], X.verdict) == ["NO", "NO.", "YES", "NO"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.integers(0, 80))
def test_answer_prefix_grows_to_the_answer(answer, cut):
    whole = json.dumps({"answer": answer, "citations": []})
    got = answer_so_far(whole)
    assert got.encode("utf-16", "surrogatepass").decode("utf-16", "replace") == answer.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    part = answer_so_far(whole[:cut])
    assert part is None or got.startswith(part)


def test_answer_prefix_edges(spark):
    texts = ['{"answer": "a\\nb', '{"answer": "x\\u00', '{"answer": "q\\', '{"ans', '{"answer" : "say \\"hi\\"", "c": 1}', None, '{"answer": "\\q"}']
    assert column(spark, texts, answer_prefix) == ["a\nb", "x", "q", None, 'say "hi"', None, "q"]
