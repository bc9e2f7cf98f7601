"""The registered queries of the folder, against SQL where SQL can express them."""

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, difference
from ledgerloom.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_check(spark, name):
    assert difference(queries()[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted({*QUERIES, "pipeline"} - set(ORACLE)))
def test_query_has_rows(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0
