"""Every registered query against its SQL, and what its plan may not contain."""

import importlib
import re

import pytest

check = importlib.import_module("check")
entry = importlib.import_module("__spark_entry__")
QUERIES = importlib.import_module("fleetloom.catalogue").QUERIES
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal_to_sql(spark, con, name):
    result, _ = check.compare(spark, con, SMALL, name)
    assert result.startswith("ok"), result


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


# Global aggregates and sorted top rows end in one partition by nature; there are only partial results left there.
GLOBAL = {"archive_run_empty", "key_bounds", "gate_counts", "key_profile", "archive_run", "first_n", "last_n", "nth_row", "shard_coverage", "converge_exact", "converge_count"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_single_task_step(spark, name):
    if name.startswith("stream") or name.startswith("running_state") or name in ("ensure_table", "restore_latest"):
        pytest.skip("reads back what it wrote")
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert name in GLOBAL or "SinglePartition" not in plan, plan
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), plan


@pytest.mark.parametrize("name", ["top_n_per_group", "periodic_capture"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search("WindowGroupLimit.*Partial", plan)
