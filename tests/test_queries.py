"""Every registered query against its checking SQL on the smallest data set."""

import pytest

import __spark_entry__ as contract
import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    query, sql = contract.queries()[name], contract.oracle_sql().get(name)
    if sql is None:
        assert query(spark, FOLDER).count() > 0
        return
    rows, problem = oracle.compare(spark, con, FOLDER, query, sql)
    assert problem is None


def test_entry(spark):
    assert "rule" in contract.entry(spark).columns
