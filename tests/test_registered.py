"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as contract
import oracle
from floodlens.plans.registry import all_queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: job for name, job in contract.queries().items() if name in all_queries()}
ORACLES = {name: sql for name, sql in contract.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, con):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
