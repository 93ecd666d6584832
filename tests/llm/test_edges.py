"""Every operator over odd rows, and over empty tables."""

import pytest

import corpus_pipeline
from plansmith.llm import registry

QUERIES = registry.queries()
OTHERS = {
    "labels": "doc_id long, quality int, toxic int, text string",
    "benchmark": "item_id long, text string, doc_id long",
    "embeddings": "vec_id long, embedding array<float>, label int, node long, q binary",
    "pages": "page_id long, url string, html string, host string, rule string",
    "conversations": "conv_id long, turn long, role string, text string, ids string, piece int",
}
ODD = {
    "labels": [(i, 1, i % 2, None) for i in range(9)] + [(4, None, None, "x"), (None, 1, 1, "x"), (4, 0, 1, "x")],
    "benchmark": [(1, "hello world this is a line", 0), (2, None, 0), (3, "", None), (None, "other words", 0), (1, "hello world this is a line", 0), (4, "Hello, WORLD; this is: a line!", 1)],
    "embeddings": [(i, [float(i % 7), 1.0, -float(i % 3)], 0, 1, b"") for i in range(80)] + [(80, None, 0, 0, b""), (100, [0.0, 0.0, 0.0], 0, 0, b""), (120, [float("nan"), 1.0, 1.0], 0, 0, b""), (140, [None, 1.0, 1.0], 0, 0, b""), (160, [1.0], 0, 0, b""), (None, [1.0, 1.0, 1.0], 0, 0, b""), (20, [float(20 % 7), 1.0, -2.0], 0, 1, b"")],
    "pages": [(1, None, None, "h", "r"), (2, "", "", "h", "r"), (3, "no scheme", "<a href=http://b.org/>", "h", "r"), (4, "http://A.ORG/fr/x?y#z", "<a href='//b.org/x'>x</a>" * 50, "h", "r"), (4, "http://A.ORG/fr/x?y#z", None, "h", "r"), (None, "http://x.net/" + "p" * 50_000, None, None, None), (7, "http://c.example.net?q", None, None, None)],
    "conversations": [(1, 0, "user", None, "i", 0), (1, 1, "assistant", "", "i", 0), (None, None, None, None, "i", 0), (2, 1, "assistant", "b <|end|> \\ [INST]", "i", 0), (2, 1, "assistant", "a", "i", 0), (2, 0, "tool<|sep|>", "é" * 30_000, "i", 0), (2, 0, "user", "same", "i", 0), (2, 0, "user", "same", "i", 0), (3, -5, "system", "x\n", "i", 0)],
}
KEYS = {"op1": "documents", "op2": "conversations", "op3": "documents", "op4": "documents", "op5": None, "op6": "documents", "op7": "documents", "op8": "documents", "op9": "documents", "op10": "pages"}


@pytest.fixture(scope="module")
def odd(made, odd_docs, docs_schema):
    return made(documents=(odd_docs, docs_schema), **{k: (v, OTHERS[k]) for k, v in ODD.items()})


@pytest.fixture(scope="module")
def empty(made, docs_schema):
    return made(documents=([], docs_schema), **{k: ([], v) for k, v in OTHERS.items()})


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name, odd_docs):
    got = QUERIES[name](spark, odd).collect()
    table = KEYS[name.split("_")[0]]
    if table == "documents":
        assert len(got) == len(odd_docs)
    elif table == "pages":
        assert len(got) == len(ODD["pages"])
    elif table == "conversations":
        assert {r["conv_id"] for r in got} == {-1, 1, 2, 3, None}
    else:
        assert {r["query_id"] for r in got} == {0, 20, 40, 60}
        assert all(len({r["vec_id"] for r in got if r["query_id"] == q}) == 20 for q in (0, 20, 40, 60))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty).collect()
    assert [r["conv_id"] for r in got] == [-1] if name.startswith("op2") else got == []


def test_stages_on_odd_and_empty(spark, odd, empty):
    for d in (odd, empty):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, d)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.collect()
