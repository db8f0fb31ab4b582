import random

import pytest

WORDS = [a + b for a in ("al", "be", "ci", "do", "fu", "ga") for b in ("na", "ro", "ti", "mu", "le")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if i % 9 == 8 else "") + ("\n" if i % 23 == 22 else "") for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, copies, and columns with names that operators use inside."""
    long = prose(1, 30_000)
    near = prose(2, 300)
    passage = prose(3, 80)
    rows = [
        (1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "null id, but a text of its own " + prose(4, 40), "x"), (None, None, None), (3, long, "x"), (4, near, "x"), (5, near, "x"),
        (6, near.replace(near.split()[50], "changed", 1), None), (7, prose(5, 60) + passage, "x"), (8, passage + prose(6, 50), "x"), (8, passage + prose(6, 50), "x"), (9, "two words", "x"),
        (10, "ab " * 200, "x"), (11, "é" * 500 + " 日本語　全角   x", "x"), (12, " \n\t ", "x"), (13, "# | $ % & " * 30, "x"), (14, "a\x00b", "x"), (15, "<|endoftext|>  <|endoftext|>", "x"),
    ]
    return spark.createDataFrame([(*r, 1.0, 2, "y") for r in rows], "doc_id long, text string, lang string, score double, rank int, _text string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(odd):
    return [(r.doc_id, r.text or "") for r in odd.collect()]
