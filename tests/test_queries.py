"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as driver
from gatewright.plans import registry
from tests.oracle import compare, connect

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf, name):
    ok, message = compare(spark, con, QUERIES[name], ORACLES.get(name), sf)
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and {r.status for r in rows} <= {"PASSED", "PASSED WITH ADVISORIES", "ACTION REQUIRED"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairwise_join(spark, sf, name):
    """No query compares every row of one side with every row of the other."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
