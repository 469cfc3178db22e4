import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of texts, or of (text, source) pairs; ids count from 0."""

    def make(texts, ids=None):
        rows = []
        for i, t in enumerate(texts):
            text, source = t if isinstance(t, tuple) else (t, "s")
            rows.append((i if ids is None else ids[i], text, "en", source, None if text is None else len(text)))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, very long ones, copies and odd characters."""
    return [None, "", " \n\t ", "a", "a", "word " * 30_000, "x" * 120_000, "é" * 500 + " 😀\x00 ", "Same text here.\nAnd here.", "Same text here.\nAnd here.", "." * 5_000, "\n" * 3_000, "1" * 20_000, "@" * 2_000, "İ!"]
