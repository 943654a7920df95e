"""Operators on pages and vectors, and the registered queries."""

from collections import Counter

import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.llm import ORACLES, QUERIES, topk, urls

URLS = [
    "http://A.Example.NET/en/x?y#z", "https://example.net/de/", "https://net/", "https://notnet/", "http://x.example.com/de/1", "http://x.example.com/d", "https://fr.org/fr/", "https://org/fr",
    "https://example.net", None, "", "no scheme/net/", "https://", "ftp://user@net/x", "https://É.net/en/?a://b", "http://a.b.c.d.example.net/en/" + "x" * 100_000, "http://net/a\nb",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def test_urls(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, path string")
    want = Counter((i, *brute(u)) for i, u in enumerate(URLS + URLS[:3]))
    assert Counter(map(tuple, urls.judged(pages).collect())) == want
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    assert Counter(map(tuple, urls.judged(pages).collect())) == want
    # rules in a table, too many for a broadcast, and small enough for one
    table = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    assert Counter(map(tuple, urls.judged(pages, table).collect())) == want
    monkeypatch.undo()
    assert Counter(map(tuple, urls.judged(pages, table).collect())) == want
    assert urls.judged(pages.limit(0)).collect() == []
    # a host of very many labels takes no more probes than any other
    long = spark.createDataFrame([(1, "http://" + "a." * 300_000 + "net/x")], "page_id long, url string")
    assert urls.judged(long).head().rule == "net/"


def test_no_rules_and_colliding_digests(spark):
    pages = spark.createDataFrame([(1, "https://net/")], "page_id long, url string")
    assert urls.judged(pages, ()).head().verdict == "allow"
    index = urls.DigestArray(urls.pack(urls.RULES))
    index.keys = np.full(len(index.keys), index.keys[0])
    assert index.find([b"nowhere/"]).tolist() == [-1]


def brute_topk(rows, k=10, stride=100):
    use = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in use), default=0)
    use = [(i, np.pad(v, (0, dim - len(v)))) for i, v in use]
    out = Counter()
    for a, (i, v) in enumerate(use):
        if i % stride == 0:
            scored = sorted((-int(v @ w), j) for b, (j, w) in enumerate(use) if b != a)[:k]
            for r, (s, j) in enumerate(scored, 1):
                out[i, r, j, -s] += 1
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_topk(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(topk, "CANDIDATES", 40)
        monkeypatch.setattr(topk, "SHELL", 5)
        monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(420)]
    rows += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (800, [float("inf")]), (None, [1.0] * 8), (900, []), (1000, [2.0, 1.0]), (1100, [3.0] * 8)]
    rows += [rows[100], rows[100], (100, [9.0] * 8), (421, rows[5][1]), (422, rows[5][1]), (1100, [3.0] * 8)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score long, v string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert Counter(map(tuple, topk.nearest(df).collect())) == brute_topk(rows)


def test_topk_of_equal_vectors(spark, monkeypatch):
    """A third of all rows are one vector: no block holds them all."""
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    monkeypatch.setattr(topk, "SHELL", 10)
    rows = [(i, [1.0, 2.0] if i % 3 else [float(i % 7), -float(i % 11)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.nearest(df).collect())) == brute_topk(rows)


def test_topk_beyond_longs(spark):
    ends = 2**63 - 1, -(2**63)
    assert topk.whole(np.array([1e17, -1e17, 0.5, 9007199254740992.0])).tolist() == [*ends, 512, 9007199254740992 * 1024 if 9007199254740992 * 1024 < 2**63 else ends[0]]
    rows = [(0, [1e17, 0.0]), (1, [1e17, 1.0]), (2, [-1e17, 0.0]), (3, [0.001, 0.0]), (4, [0.0, 1.0])]
    got = topk.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, ends[0]), (0, 2, 3, ends[0]), (0, 3, 4, 0), (0, 4, 2, ends[1])]


def test_topk_spares_work(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.searched(df).collect()
    assert max(r.evaluated for r in got) < 1500
    assert Counter(tuple(r)[:4] for r in got) == brute_topk(rows)


def test_topk_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.nearest(spark.createDataFrame([], schema)).collect() == []
    assert topk.nearest(spark.createDataFrame([(100, [1.0])], schema)).collect() == []
    assert [tuple(r) for r in topk.nearest(spark.createDataFrame([(100, [1.0]), (1, [-2.0])], schema)).collect()] == [(100, 1, 1, -2 * 1024 * 1024)]


def test_pivots_spare_work():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (20, 16))
    x = np.concatenate([c + rng.integers(-20, 20, (500, 16)) for c in centres])
    most = float((x.astype(float) ** 2).sum(1).max())
    lift = topk.Lift(topk.farthest_first(x[::7], 32), most)
    ids = np.arange(len(x))
    q = x[:5]
    seen = [n for *_, n in topk.search(ids, x, lift.distances(x, False), q, lift.distances(q, True), most, 10)]
    assert max(seen) < len(x)
    for i, rows, scores, _ in topk.search(ids, x, lift.distances(x, False), q, lift.distances(q, True), most, 10):
        assert scores.tolist() == sorted((x @ q[i]).tolist(), reverse=True)[:10]


@pytest.mark.parametrize("name", ORACLES)
def test_queries_with_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_five_stages():
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
