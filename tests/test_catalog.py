"""Every query of the driver contract against its SQL, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from meterlake.demo.catalog import QUERIES
from meterlake.demo.oracles import ORACLES
from tests.oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR)
    assert problem in (None, "no rows"), problem


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
