"""Every registered query against its SQL twin on the smallest tables."""

import check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    problem, _ = check.compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
