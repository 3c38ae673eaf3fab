"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_comparison_notices_a_difference(spark, con):
    wrong = SQL["node_degree"].replace("FROM degrees", "FROM degrees WHERE degree <> 1")
    assert differences(QUERIES["node_degree"](spark, SF), con, wrong) is not None


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"graph_id", "decision", "reason"}
