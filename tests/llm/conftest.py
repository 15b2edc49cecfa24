import pytest


#: Nulls in every column, empty and very long texts, ties and repeated rows, and an extra column whose name clashes.
ODD = [
    (1, "Alpha beta.\ngamma delta epsilon", "en", "a", 10, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "b", 0, "y"),
    (None, "no id at all here", "en", "a", 3, "z"),
    (5, "word " * 30_000, "fr", "b", 150_000, "x"),
    (6, "Ünïcode 😀 text\n\nwith lines\n", "de", "c", 5, "x"),
    (7, "same text twice in here", "en", "a", 1, "x"),
    (7, "same text twice in here", "en", "a", 1, "x"),
    (8, " \t\n\r ", "en", "", 1, "x"),
]


@pytest.fixture
def odd(spark):
    return lambda extra="size": spark.createDataFrame(ODD, f"doc_id long, text string, lang string, source string, n_chars long, `{extra}` string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
