import pytest


@pytest.fixture(scope="session")
def made(spark, tmp_path_factory):
    """Writes tables as Parquet and gives their folder."""

    def write(**tables):
        d = tmp_path_factory.mktemp("tables")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, fp long, keys string, kept string, hits string, size long, _id long"


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names the operators use."""
    long = " ".join(f"palabra{i % 977}" for i in range(60_000))
    texts = [None, "", "   \n\n", "12345 !!", "hello world this is a line\nshort\nhello world this is a line", "HELLO WORLD THIS IS A LINE  \nother words here today", long, "éàü ñ", "x" * 200_000]
    rows = [(i, t, None if i % 3 == 0 else "en" if i % 2 else "fr", None if i % 4 == 0 else f"s{i % 2}", None, 1.0, 2, 3, "k", "k", "h", 4, 5) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "hello world this is a line", None, None, None, None, None, None, None, None, None, None, None), (100, long, "en", "s0", 1, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs_schema():
    return DOCS
