import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size string, score double, `a.b` int, __row int, coverage int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog near the old river bank while "
    rows = [
        (1, prose * 3, "en", "a", 1, 1, "x", 0.1, 1, 1, 1),
        (1, prose * 3, "en", "a", 1, 1, "x", 0.1, 1, 1, 1),
        (2, None, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 1, "x", 0.1, 1, 1, 1),
        (None, "a null id with password=abcdef123456 inside", "en", None, 1, 1, "x", 0.1, 1, 1, 1),
        (4, "12 34 !! ..", "en", "b", 1, 1, "x", 0.1, 1, 1, 1),
        (5, "word", "de", "b", 1, 1, "x", 0.1, 1, 1, 1),
        (6, (prose + "und der die das ") * 3000, "de", "b", 1, 1, "x", 0.1, 1, 1, 1),
        (7, "Ünïcödé 漢字 \U0001f600 ſ token: 'x1y2z3a4'", "de", "c", 1, 1, "x", 0.1, 1, 1, 1),
        (8, prose * 3 + "end", None, "c", 1, 1, "x", 0.1, 1, 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
