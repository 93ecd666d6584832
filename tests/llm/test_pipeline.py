import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_near_copies import brute_lines, components, fingerprint  # noqa: E402
from test_scans import fill  # noqa: E402

import corpus_pipeline  # noqa: E402
from plansmith.llm import decontamination  # noqa: E402


def test_pipeline_equals_brute_force(spark, made):
    import random

    rng = random.Random(8)
    text = lambda n: ". ".join(" ".join(f"word{rng.randrange(400)}x" for _ in range(9)) for _ in range(n))
    docs = {i: "\n".join(text(rng.randrange(1, 5)) for _ in range(3)) for i in range(60)}
    docs |= {60 + i: docs[i] for i in range(10)} | {70: "123 456", 71: None, 72: ""}
    shared = "This line lies in many of the documents"
    for i in range(0, 60, 4):
        docs[i] += "\n" + shared
    leak = " ".join(f"leak{i}" for i in range(20))
    docs[80], docs[81] = "before " + leak, text(60) + " " + leak + " after"
    d = made(documents=([(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long"), benchmark=([(1, leak)], "item_id long, text string"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    want = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    want = brute_lines(want)
    root = components({i: fingerprint(t) for i, t in want.items()})
    want = {i: t for i, t in want.items() if root[i] == i}
    w = decontamination.WindowSet([(1, leak)])
    for i, t in list(want.items()):
        ws = decontamination.words(t)
        hits, _ = w.scan(ws)
        n = sum(e - s for s, e in hits)
        if n and 20 * n >= len(ws):
            del want[i]
        elif n:
            want[i] = decontamination.without(t, hits)
    assert 80 not in want and leak not in want[81]
    sizes = {}
    for i, t in want.items():
        sizes[f"s{i % 3}"] = sizes.get(f"s{i % 3}", 0) + len(t.split())
    target = fill(sizes)
    assert set(got) <= set(want) and all(got[i]["text"] == want[i] and got[i]["n_chars"] == len(want[i]) for i in got)
    for s in sizes:
        # documents that give nothing are not in the mix; the schedule's first slots hit a target but for some blocks
        assert abs(sum(r["taken"] for i, r in got.items() if f"s{i % 3}" == s) - target[s]) <= 10


def test_near_stage_keeps_one_row_of_a_component(spark):
    from plansmith.llm import simhash

    t = " ".join(f"w{i}" for i in range(60))
    rows = [(5, t), (5, t), (5, t + " tail"), (7, t), (None, t), (None, "other words"), (None, "other words"), (None, None), (9, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.drop_near_copies(docs).collect()), key=repr)
    texts = [x for i, x in got if i == 5]
    assert len(texts) == 1 and sorted(((i, x) for i, x in got if i != 5), key=repr) == sorted([(None, "other words"), (None, None), (9, "alone")], key=repr)


def test_language_stage_rejects_what_no_language_is_told_of(spark):
    import numpy as np

    from plansmith.llm import langid

    model = langid.Model(["a", "b", "c", "d"], np.zeros((langid.BUCKETS, 4), np.float32), np.zeros(4))
    assert model.predict(["text"])[0][1] == 0.25  # nothing is told apart: under the least score of the stage
    assert langid.LEAST > 0.25


def test_language_stage_keeps_unlabelled_documents(spark):
    from plansmith.llm import langid

    rows = [(1, "some words", None), (2, "123 !!", None), (3, None, None), (4, "é", None), (None, "more words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in langid.keep_recognised(docs).collect()} == {rows[0], rows[3], rows[4]}
