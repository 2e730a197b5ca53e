"""Awkward rows that every operator on documents must take."""

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, component string, host string"
LONG = "lorem ipsum dolor sit amet " * 60_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, a repeated id, columns with clashing names."""
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "b", 1, 7, "x", "h"), (2, "one two three four five six seven eight nine ten", "en", "b", 1, 7, "x", "h"),
        (3, None, "en", "a", None, None, None, None), (4, "", None, None, 0, 0, "", ""), (None, "one two three four five six seven eight nine ten", "de", "a", 1, 1, "y", "z"),
        (5, LONG, "la", "c", 1, 1, "x", "h"), (6, "word", "en", "a", 1, 1, "x", "h"), (6, "word", "en", "a", 1, 1, "x", "h"), (7, "1234 -- !!", "en", None, 1, 1, "x", "h"), (7, "another text under the same id", "en", "a", 1, 1, "x", "h"),
    ]
    return spark.createDataFrame(rows, KIND).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KIND)
