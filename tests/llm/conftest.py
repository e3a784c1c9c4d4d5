import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and blank texts, ties, repeated rows, and further columns with clashing names."""
    long = "Lorem ipsum dolor sit amet, " * 4000
    rows = [
        (1, "", "en", "a"), (2, None, None, None), (3, "   \n\t ", "en", "a"), (4, "one two three four five six seven eight nine ten eleven.", "en", "b"),
        (5, "one two three four five six seven eight nine ten eleven.", "en", "b"), (6, long, None, "b"), (7, "x", "fr", None), (8, "été déjà vu! " * 30, "fr", "a"),
        (9, "12345 678 90", "de", "a"), (9, "12345 678 90", "de", "a"),
    ]
    return spark.createDataFrame([(*r, 0, "h", 1, -1) for r in rows], "doc_id long, text string, lang string, source string, n_words int, h string, size int, start int")
