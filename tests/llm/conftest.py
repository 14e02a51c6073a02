import pytest

pytest.importorskip("graphloom.llm")


@pytest.fixture
def docs(spark):
    """Rows of documents with nulls, empty texts, ties, repeated rows and an extra column that clashes with inner names."""

    def make(rows):
        kinds = "doc_id long, text string, lang string, source string, n_chars long, row long, node string, h string"
        return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None, 1, "x", "y") for i, t, g, s in rows], kinds)

    return make


EDGE = [(1, None, None, None), (2, "", "en", "a"), (None, "some words here and there", None, "a"), (3, "!?", "xx", None), (4, "same text here for all", "en", "b"), (4, "same text here for all", "en", "b"), (5, "word " * 30000, "en", "b")]


@pytest.fixture
def edge(docs):
    return docs(EDGE)


@pytest.fixture
def none(docs):
    return docs([])
