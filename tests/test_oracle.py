"""Every registered query against its DuckDB check query, over whole tables."""

import pytest

from __spark_entry__ import _queries as queries
from __spark_entry__ import entry, oracle_sql
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(queries()) <= set(CHECKS)


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_check(spark, duck, name):
    assert difference(queries()[name](spark, FOLDER), duck, CHECKS[name]) is None


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry(spark)
    assert df.schema == entry(spark).schema
    assert df.count() > 0
