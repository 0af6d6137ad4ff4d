"""Odd document tables that every operator must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a long text, columns with clashing names."""
    long = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
    twin = "the same words stand here twice over and over again " * 12
    rows = [
        (1, None, None, None, None, "x", "k"), (2, "", "en", "b", 0, None, None), (3, " \t\n ", "en", "a", 4, None, None), (4, "one", "en", "a", 3, None, None), (4, "one", "en", "a", 3, None, None),
        (5, twin, "en", "a", len(twin), None, None), (6, twin, "en", None, len(twin), None, None), (None, "a row without an id, with some words in it", "de", "c", 5, None, None),
        (7, "ß é 中文 😀 <|endoftext|> don't  stop\x1c\x85", "xx", "c", 5, None, None), (8, long, "en", "a", len(long), "1", "2"), (9, long[:5000] + " changed " + long[5000:9000], "en", "a", 1, "1", "2"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
