import random
import re

import numpy as np
import pytest
import xxhash

from plansmith.llm import line_dedup, simhash
from plansmith.llm.common import Scratch


def fingerprint(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]).encode(), 42) for k in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=4):
    ids, up = sorted(fps), {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(80)) for _ in range(30)]
    out = list(base)
    for b in base[:12]:
        ws = b.split()
        ws[rng.randrange(80)] = "X"
        out += [" ".join(ws), b, b.upper() + "\n"]
    return dict(enumerate([*out, None, "", " \t", "one two", "one  TWO"]))


@pytest.mark.parametrize("how", [{}, {"words": 1}, {"crowd": 2}])
def test_simhash_equals_brute_force(spark, texts, how):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    want = components(fps)
    got = simhash.cluster(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **how).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_links_lose_nothing(spark):
    """Fingerprints in a tight crowd, where variants are shared by many."""
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for s in seeds for _ in range(80)}
    signed = [int(x) for x in np.array(sorted(fps), np.uint64).view(np.int64)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components({x: x % (1 << 64) for x in signed})
    for how in ({"words": 2, "crowd": 8}, {"words": 2, "crowd": 64}, {"words": 1}):
        scratch = Scratch(spark, "test")
        got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, scratch, **how), scratch).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def brute_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holds = {}
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holds.setdefault(key(x), set()).add(i)
    gone = {k: min(v) for k, v in holds.items() if len(v) > 1}
    return {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in docs.items()}


def test_lines_insert_and_delete(spark):
    rng = random.Random(2)
    lines = [f"Line number {i} é" for i in range(40)] + ["short", "", "  \t"]
    docs = {i: "\n".join(rng.choice(lines) + rng.choice(["", "  ", "\r"]) for _ in range(rng.randrange(12))) for i in range(60)}
    kind = "doc_id long, text string"
    rows = list(docs.items())
    index = line_dedup.LineIndex(spark)

    def kept(ids):
        part = spark.createDataFrame([(i, docs[i]) for i in ids], kind)
        return {r["doc_id"]: r["kept"] for r in index.deduplicated(part).collect()}

    index.insert(spark.createDataFrame(rows[20:40], kind))
    assert kept(range(20, 40)) == brute_lines(dict(rows[20:40]))
    index.insert(spark.createDataFrame(rows[:20], kind))
    index.insert(spark.createDataFrame(rows[40:], kind))
    assert kept(range(60)) == brute_lines(docs)
    gone = set(range(0, 60, 3))
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = {i: t for i, t in docs.items() if i not in gone}
    assert kept(left) == brute_lines(left)
    index.delete(spark.createDataFrame([(i,) for i in range(20, 60)], "doc_id long"))
    left = {i: t for i, t in left.items() if i < 20}
    assert kept(left) == brute_lines(left)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    f = line_dedup.CuckooFilter.sized(2000)  # too small for all: the rest goes to the stash
    f.add(keys)
    assert f.holds(keys).all()
    f = line_dedup.CuckooFilter.load(f.dump())
    assert f.holds(keys).all() and f.holds(rng.integers(0, 256, (20_000, 16), dtype=np.uint8)).mean() < 0.01
    f.remove(keys[:1500])
    assert f.holds(keys[1500:]).all() and f.holds(keys[:1500]).mean() < 0.01
