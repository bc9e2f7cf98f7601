"""The same checks on data where one key holds a third of the rows, hot path forced."""

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, difference
from checks.skewed import write
from ledgerloom.operators import skew

CHECKS = oracle_sql()
# One query per way in which hot keys reach a join.
NAMES = ["P3", "P8", "P11", "QA-01", "QA-05", "QA-07", "QA-10", "QA-P", "C6", "C9", "T-state", "A10", "ST1"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write("/root/testdata/sf0.001", str(tmp_path_factory.mktemp("skewed")))


@pytest.fixture(autouse=True)
def small_tasks(monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)


def test_the_data_is_skewed(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    for key in ("l_orderkey", "l_partkey"):
        crowded = skew.crowded_keys(skew.count_rows(lines, [key]), [key])
        assert crowded.agg({"_parts": "max"}).first()[0] > 10


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_check(spark, folder, name):
    assert difference(queries()[name](spark, folder), connect(folder), CHECKS[name]) is None
