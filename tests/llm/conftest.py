import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

EDGE = [None, "", " \n ", "!!! ???", "a", "Das ist ein Haus am See und es ist alt.", "Das ist ein Haus am See und es ist alt.", "x " * 30_000, "the cat sat on the mat and it was very old " * 3, "日本語 текст ελληνικά", "<|endoftext|> it's 42"]


@pytest.fixture()
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i if i != 3 else None, t, None if i % 3 == 0 else "de", None if i % 4 == 0 else "s", None, "x", 1) for i, t in enumerate(EDGE)]
    return spark.createDataFrame([*rows, rows[5], rows[5]], COLUMNS + ", shard string, score int")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
