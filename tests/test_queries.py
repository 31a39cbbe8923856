"""The library's own queries against their SQL, as the driver does."""

import pytest

import __spark_entry__ as entry
from rendered.expected import statements
from rendered.queries import all_queries
from tests.check import compare, database
from tests.conftest import SF_DIR

QUERIES, ORACLES = all_queries(), statements()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) == ""


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["page_id", "url", "title", "first_link"] and got.count() == 50
