import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows, one long text.
ODD = [
    (0, "the quick brown fox jumps over the lazy dog again and again", "en", "src0", 59), (1, "", "en", "src0", 0), (2, None, None, None, None), (3, " \t\n ", "de", "src1", 4),
    (4, "the quick brown fox jumps over the lazy dog again and again", "en", "src1", 59), (5, "one", None, "src2", 3), (5, "one", None, "src2", 3), (None, "no id here", "fr", "src0", 10),
    (7, "wörd \x0b mit ünïcode 😀 " * 40, "de", "src0", 0), (8, "long " * 40_000, "en", "src0", 200_000), (9, "A B C\nA B C\n\nA b c", "en", None, 1),
]


CLASHES = ("tokens", "copies", "range", "id", "key", "n", "kept", "pool", "_w", "_t", "part", "_score", "slice", "full", "cut", "_nth", "_gone", "_day", "_host", "_l", "_s", "_domain", "_lang", "_source", "score", "host", "day", "_marks", "distance")


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(ODD, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


def untouched(rows):
    """Whether the extra columns came through as they were; those that an operator's docstring says it replaces are left out."""
    return all(r[c] == k for r in rows for k, c in enumerate(CLASHES) if c not in ("tokens", "copies"))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
