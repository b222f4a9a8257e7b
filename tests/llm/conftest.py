import pytest

from quiverql.llm.common import local_spark


@pytest.fixture(scope="session")
def spark():
    session = local_spark()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def docs_of(spark):
    """A documents frame of (doc_id, text) rows, with columns whose names could clash."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), "x", 1.5) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, u string, score double")

    return make


#: Nulls, empty and very long texts, repeats and ties.
ODD_ROWS = [
    (1, None), (2, ""), (3, " \n \t\n"), (4, "one"), (4, "one"), (5, "one"), (None, "a null id is a row too"), (6, "é" * 5000), (7, "word " * 30000), (8, "x" * 100000),
    (9, "\n" * 500), (10, "Mixed CASE\r\nline two\x0bthree\x0cfour"), (11, "日本語 текст ünïcode 😀 " * 20),
]


@pytest.fixture
def odd_docs(docs_of):
    return docs_of(ODD_ROWS)
