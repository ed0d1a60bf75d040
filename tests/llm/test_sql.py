"""Queries with SQL, on the smallest tables; every one must take whole tables."""

import importlib

import pytest

check = importlib.import_module("check")
queries = importlib.import_module("fleetloom.llm.queries")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(spark, con, name):
    result, _ = check.compare(spark, con, SMALL, name)
    assert result.startswith("ok") and "EMPTY" not in result, result


def test_one_query_for_each_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op5_mix_sources"])
def test_native_plan(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin")), plan
