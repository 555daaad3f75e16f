import pytest

#: Rows that every operator must take: nulls in any column, empty and odd texts, repeated rows, a very long text, clashing names.
LONG = "the quick brown fox jumps over the lazy dog " * 20_000
ROWS = [
    (1, "The quick, brown fox.\nJumps over!", "en", "a", 3, "x"),
    (1, "The quick, brown fox.\nJumps over!", "en", "a", 3, "x"),
    (2, None, "en", "a", None, None),
    (3, "", None, None, 0, "y"),
    (None, "no id here but some words anyway", "en", "b", 1, None),
    (None, None, None, None, None, None),
    (4, LONG, "en", "b", 5, "z"),
    (5, "été où ça naïve straße ÀÉ İ 漢字 😀 a\u0301", "fr", "é", 2, "w"),
    (6, "   \t\n ", "de", "b", 1, "w"),
    (7, "1234 5678 !!! ???", "de", "b", 1, "w"),
    (-8, "one", "es", None, 1, "w"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, score string"


@pytest.fixture(scope="session")
def odd(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("hits", "fp", "component_id", "taken", "__text", "__id", "x", "row", "block", "vec_id"):
        docs = docs.withColumn(c, docs["score"])
    return docs


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
