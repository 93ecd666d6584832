import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plansmith.llm import langid, neighbours, toxicity

def table(name, size="sf0.01"):
    return pq.read_table(f"/root/testdata/{size}/{name}.parquet").to_pylist()


def test_languages_held_out():
    docs = table("documents")
    kept = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2 and d["lang"]]
    m = langid.train([(d["lang"], d["text"]) for d in kept])
    test = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    got = m.predict([d["text"] for d in test])
    assert np.mean([g[0] == d["lang"] for g, d in zip(got, test, strict=True)]) > 0.98
    assert all(0 <= s <= 1 for _, s in got) and m.predict([None, "", "123 !"]) == [("und", 0.0)] * 3


def test_presence_kernel():
    w = langid.windows_of(" abcabc ")[0]
    x = langid.presence([w, w, np.zeros(0, np.uint32)])
    grams = {" abcabc "[i : i + n] for n in (1, 2, 3) for i in range(9 - n)}
    assert (x[0] == x[1]).all() and x[2].sum() == 0 and x[0].sum() == pytest.approx(len(grams), abs=1)


def order(s, y):
    rank = np.empty(len(s))
    rank[np.argsort(s, kind="stable")] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_held_out():
    text = {d["doc_id"]: d["text"] for d in table("documents", "sf0.1")}
    rows = [(r["doc_id"], r["toxic"], text[r["doc_id"]]) for r in sorted(table("labels", "sf0.1"), key=lambda r: r["doc_id"])]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    m = toxicity.train([(y, t) for i, y, t in rows if not held(i)])
    y = np.array([k for i, k, _ in rows if held(i)])
    s = np.array([m.score(t) for i, _, t in rows if held(i)])
    assert order(s, y) > 0.85 and y[s >= 0.5].mean() > 0.75
    assert 0 <= m.score(None) == m.score("") < 0.5 and toxicity.train([(1, "a"), (0, "b")]).score("x") == 0


def test_toxicity_finds_new_words_of_known_kinds():
    rng = np.random.default_rng(0)
    syllables = ["ta", "ren", "mo", "shi", "lu", "ver", "an", "pol", "ek", "dis"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(900):
        ws = [word() for _ in range(rng.integers(30, 200))]
        for _ in range(3 if i % 3 == 0 else 0):
            ws[rng.integers(len(ws))] = str(rng.choice(["zorgblat", "quixfump", "kwyjibo"])) + word()
        rows.append((int(i % 3 == 0), " ".join(ws)))
    m = toxicity.train(rows[:600])
    assert order(np.array([m.score(t) for _, t in rows[600:]]), np.array([k for k, _ in rows[600:]])) > 0.9


def _search(spark, x, queries, k=neighbours.K, kind="double", **how):
    """Rows of x as an index, queries of (id, vector): the result, and the index."""
    index = neighbours.Index(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>"), k=k)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in queries], f"query_id long, embedding array<{kind}>")
    return index.search(asked, **how).toPandas().sort_values(["query_id", "rank"]), index


def _recall(x, queries, got, top=20):
    hit = []
    for i, v in queries:
        s = x @ v
        if i >= 0:
            s[i] = -np.inf
        g = got[got["query_id"] == i]
        assert list(g["rank"]) == list(range(1, top + 1)) and np.allclose(g["score"], s[g["vec_id"]], rtol=1e-12)
        assert list(np.lexsort((g["vec_id"], -g["score"]))) == list(range(top))
        hit.append(np.mean(g["score"] >= np.sort(s)[-top] * (1 - 1e-12)))
    return np.mean(hit)


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16)) * rng.uniform(0.2, 2, (700, 1))  # norms differ: inner product isn't cosine
    x[300:360] = x[7]
    queries = [(i, x[i]) for i in range(0, 700, 20)]
    got, index = _search(spark, x, queries)
    assert _recall(x, queries, got) >= 0.97
    # queries that are no rows of the index
    new = [(-i - 1, rng.standard_normal(16)) for i in range(10)]
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in new], "query_id long, embedding array<double>")
    assert _recall(x, new, index.search(asked).toPandas().sort_values(["query_id", "rank"])) >= 0.9


def test_neighbours_with_outlying_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12))
    x[7] *= 1e4
    x[11] *= 1e-9
    x[13] = 1e-200 * x[14]  # its squares underflow
    queries = [(i, x[i]) for i in range(400) if i % 20 == 0 or i in (7, 11, 13)]
    got, _ = _search(spark, x, queries)
    assert _recall(x, queries, got) >= 0.97
    x[7] = 1e200 * x[15] / np.abs(x[15]).max()  # and these overflow
    got, index = _search(spark, x, [(0, x[0]), (7, x[7])])
    assert index.n == 400 and got.groupby("query_id").size().tolist() == [20, 20]


def test_neighbours_go_on_until_settled(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 8))
    queries = [(i, x[i]) for i in range(0, 1500, 20)]
    got, index = _search(spark, x, queries, k=12)
    fresh, held = index.lists.selectExpr("sum(fresh)", "sum(held)").first()
    assert fresh / held < neighbours.SETTLED
    assert _recall(x, queries, got) >= 0.97
    # codes whose inner products fall evenly with the distance of their ids: with two neighbours each the graph is a chain,
    # and from its one entry one of the two ends is many links away
    n = 46
    x = np.where(np.arange(n - 1) < np.arange(n)[:, None], 1.0, -1.0)
    monkeypatch.setattr(neighbours, "ENTRIES", 1)
    got, _ = _search(spark, x, [(-1, x[0]), (-2, x[-1])], k=2, top=4, width=8)
    assert {q: list(g["vec_id"]) for q, g in got.groupby("query_id")} == {-1: [0, 1, 2, 3], -2: [45, 44, 43, 42]}


def test_blocks_change_nothing_but_the_graph(spark, monkeypatch):
    """Many small blocks, floats, repeated ids and vectors."""
    monkeypatch.setattr(neighbours, "LEAST", 16)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 8)).astype(np.float32).astype(np.float64)
    x[100:160] = x[40]
    queries = [(i, x[i]) for i in range(0, 600, 20)]
    got, index = _search(spark, x, queries, kind="float")
    assert index.p == 4 and index.n == 540
    assert _recall(x, queries, got) >= 0.97


def test_dictionary_words_are_a_parameter(monkeypatch):
    docs = [[b"word%d" % (i * 300 + j) for j in range(300)] for i in range(3)]
    made = lambda: toxicity._dictionaries(docs, docs, (5,), 20, 4096, 4096).ordinary
    whole = made()
    monkeypatch.setattr(toxicity, "DICTIONARY_WORDS", 5)
    assert len(made()) < len(whole)
