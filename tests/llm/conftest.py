from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from texts; a null text has null n_chars."""

    def make(texts, langs=None, ids=None):
        langs = langs or ["en"] * len(texts)
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, la, "s", None if t is None else len(t)) for i, t, la in zip(ids, texts, langs, strict=True)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, very long, non-Latin, astral and repeated texts."""
    return [None, "", " \n\t", "a", "One two", "word " * 30_000, "привет мир", "😀 smile 😀", "same text here twice", "same text here twice", "é" * 5, "x y"]
