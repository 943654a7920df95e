from __future__ import annotations

import random

import pytest

#: Columns that documents may also have, named like the operators' own.
EXTRA = {"row_key": 1, "th": 2, "h": 3, "k": 4, "n": 5, "size": 6, "start": 7, "anchor": 8, "w": "x", "prefix": "y", "lang": "en"}
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in EXTRA.items())


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="package")
def rows():
    """(doc_id, text, source): near and exact copies, shared passages, and all the odd cases."""
    rng = random.Random(5)
    out = []
    for i in range(40):
        out.append([i, words(rng, rng.randrange(20, 160)), f"s{i % 3}"])
    for i in range(40, 70):  # near copies of a few, of one word less or more
        ws = out[i % 4][1].split()
        ws[rng.randrange(len(ws))] = "changed"
        out.append([i, " ".join(ws), "s0"])
    for i in range(70, 80):
        out.append([i, out[5][1], "s1"])
    passage = words(rng, 60)
    for i in range(80, 86):
        out.append([i, f"{words(rng, 15)} {passage}\n{words(rng, 10)}", None])
    out += [
        [100, None, "s0"], [101, "", "s1"], [102, " \t\n", None], [103, "one", "s0"], [104, "One", "s2"], [105, "a b c", "s0"], [106, "x " * 30_000, "s1"],
        [107, words(rng, 20_000, 9), "s0"], [108, "é ü\u00a0ß 日本語 🙂 " * 20, "s2"], [None, out[5][1], "s1"], [109, "!!! " * 20, "s0"],
    ]
    out += [list(out[5]), list(out[5]), [6, words(rng, 30), "s1"], [110, "\n".join(["same line here"] * 30), "s2"]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="package")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="package")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
