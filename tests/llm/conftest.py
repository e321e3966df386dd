import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    r = random.Random(7)
    return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    same = prose(60)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "   \n\t ", None, "a", 6), (None, prose(30), "en", "a", 1), (4, "A" * 200_000, "de", "a", 1),
        (5, prose(30_000), "en", "b", 1), (6, same, "en", "a", 1), (7, same, "en", "a", 1), (7, same, "en", "a", 1), (8, same.upper(), "fr", "a", 1),
        (9, "one two", "en", "a", 1), (10, "one two", "en", "a", 1), (11, "é" * 40 + " \x00 \x1c 中文字 🎉", None, None, None), (12, "1234 5678 !!", "en", "a", 1),
        (-3, prose(40) + "\n" + same, "en", "a", 1), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clashing(odd):
    """The odd table with extra columns that carry the names operators use inside."""
    from pyspark.sql import functions as F

    for c in ("raw", "drops", "kept", "node", "n", "key", "score", "h1", "drop_id", "rep_id", "part", "hits", "component_id", "toxic"):
        odd = odd.withColumn(c, F.lit(c))
    return odd
