"""Small documents that hold the odd cases every operator must bear: null, empty, long, tied and repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and then only river stone glass paper cloud seven eight again never always under over between light dark".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text) rows."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split()
    near = words[:150] + ["changed"] + words[151:]
    passage = prose(rng, 90)
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two three"),
        (9, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30)), (10, passage + " " + prose(rng, 60)),
        (11, prose(rng, 20) + " " + passage), (12, "é日本 ß " * 60), (13, "same " * 200), (14, "ab" * 400), (14, "another text under one id"),
        (15, prose(rng, 80)), (15, prose(rng, 80)), (None, base), (None, prose(rng, 70)), (16, "x" * 30_000), (17, prose(rng, 6_000)),
    ]
    return rows + [(2, base)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "src", 0, 1, "m", "p", 2) for i, t in texts],
        "doc_id long, text string, lang string, source string, id int, _row int, mark string, parts string, n int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
