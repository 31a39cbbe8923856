"""Small tables with every odd case."""

import pytest

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, repeated rows, ties, a long text."""
    prose = "the cat sat on the mat and looked at the small bird in the old tree, twice. "
    other = "wir gehen heute in den wald und suchen dort einen grossen alten baum. "
    rows = [
        (1, prose * 3, "en", "a", 5),
        (2, prose * 3, "en", "a", 5),
        (2, prose * 3, "en", "a", 5),
        (2, other, "de", "b", 5),
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, " \t\n ", "de", "a", 4),
        (None, other * 2, "de", None, 1),
        (None, None, None, None, None),
        (6, "Ünïcödé 日本 🙂 " + prose + "\n" + prose + "\n\nend", "en", "b", 9),
        (7, (prose + other) * 400 + "\n" + other, "en", "b", 9),
        (-8, "one", "en", "b", 3),
        ((1 << 60) + 1, "a\x1cb <|endoftext|>  two  blanks ", "en", "b", 3),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ["fp", "root", "text_key", "component_id", "score", "key", "pos", "n", "leaf",
             "template", "row", "bucket", "token", "tokens", "rate", "copies", "size", "curve",
             "_id", "_key", "_lines", "place", "rank", "class", "full", "pool", "x0", "m", "q"]
    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
