"""Every registered query against its SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, msg = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert ok, msg


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["members"] == 10 and row["n"] > 0 and 0 < row["auc"] < 1
    assert row["ll_cal"] < row["ll_raw"]
