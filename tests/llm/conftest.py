"""Rows that every operator over documents must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeats, and clashing extra columns."""
    long = " ".join(f"word{i % 977} the rain." for i in range(20_000))
    rows = [
        (1, "The rain in the plain falls and the wind of the hill blows on.", "en", "a", 62, 0.5, 1),
        (2, None, "en", None, None, None, None),
        (3, "", None, "a", 0, 0.5, 1),
        (4, long, "en", "a", len(long), 0.5, 1),
        (5, long, "en", "b", len(long), 0.5, 1),
        (5, long, "en", "b", len(long), 0.5, 1),
        (None, "no id here, but a text of some words all the same", "en", "a", 1, 0.5, 1),
        (6, "  \n\t ", "de", "a", 5, 0.5, 1),
        (7, "1234 !!! ???", "de", "a", 12, 0.5, 1),
        (8, "Der Regen und der Wind über dem Hügel, die Straße ist lang.", "de", "a", 59, 0.5, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
