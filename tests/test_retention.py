"""Retention against the recorded decisions and the band edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import retention
from fleetloom.plans import backup_catalogue

RULE = "0-7-365-3650"
SCHEMA = "type string, mode string, task_id string, date date, backup_status string, clear_status string, remote_backup_status string"


def day(mmdd):
    return dt.date(2019, int(mmdd[:2]), int(mmdd[2:]))


def ledger(spark, population, mode="xtrabackup"):
    return spark.createDataFrame([("db", mode, mmdd, day(mmdd), "Succ", "todo", "todo") for mmdd in population], SCHEMA)


GOLDEN = [
    ("0219", ["0214", "0215"], []), ("0219", ["0214", "0215", "0218", "0219"], ["0215"]), ("0220", ["0214", "0215", "0219"], ["0215"]),
    ("0220", ["0214", "0218", "0219"], ["0218"]), ("0221", ["0214", "0219", "0220"], ["0219"]),
]


@pytest.mark.parametrize("as_column", [False, True])
@pytest.mark.parametrize("today,population,cleared", GOLDEN)
def test_recorded_decisions(spark, today, population, cleared, as_column):
    rule = F.lit(RULE) if as_column else RULE
    got = retention.clear_list(ledger(spark, population), ["type", "mode"], "date", "task_id", day(today), rule)
    assert sorted(r["task_id"] for r in got.collect()) == cleared


@pytest.mark.parametrize("age,band", [(0, None), (1, 1), (7, 1), (8, 2), (365, 2), (366, 3), (3651, 4), (36601, None)])
def test_band_edges(spark, age, band):
    for rule in (RULE, F.lit(RULE)):
        assert spark.range(1).select(retention.age_band(F.lit(age), rule)).first()[0] == band


def test_no_rule_keeps_oldest_and_newest(spark):
    for rule in (None, F.lit(None).cast("string")):
        got = retention.clear_list(ledger(spark, ["0214", "0215", "0216"]), ["type", "mode"], "date", "task_id", day("0220"), rule)
        assert [r["task_id"] for r in got.collect()] == ["0215"]


def test_one_row_is_always_kept_and_ties_go_by_id(spark):
    got = retention.tiered_retention(ledger(spark, ["0214"]), ["type", "mode"], "date", "task_id", day("0220"), RULE).collect()
    assert [(r["kept"], r["reason"]) for r in got] == [(True, "band+newest+oldest")]
    same_day = spark.createDataFrame([("db", "m", str(i), day("0214"), "Succ", "todo", "todo") for i in range(3)], SCHEMA)
    kept = retention.tiered_retention(same_day, ["type", "mode"], "date", "task_id", day("0220"), RULE).filter("kept").collect()
    assert sorted(r["task_id"] for r in kept) == ["0", "2"]


def test_failed_rows_and_disk_guard(spark):
    rows = [("db", "m", "f1", day("0214"), "Fail", "todo", "todo"), ("db", "m", "f2", day("0214"), "Fail", "done", "todo")]
    led = spark.createDataFrame(rows, SCHEMA)
    args = (["type", "mode"], "date", "task_id", day("0220"), RULE)
    assert [r["task_id"] for r in retention.clear_list(led, *args, disk_used=80).collect()] == ["f1"]
    assert retention.clear_list(led, *args, disk_used=79.9).count() == 0


def test_latest_prefer_and_rollups(spark, rows):
    led = ledger(spark, ["0214", "0215"]).unionByName(
        spark.createDataFrame([("db", "xtrabackup", "0216", day("0216"), "Fail", "todo", "todo")], SCHEMA))
    usable = (F.col("backup_status") == "Succ") & (F.col("clear_status") != "done")
    assert rows(retention.latest_usable(led, ["type", "mode"], ["date", "task_id"], ["task_id"], usable)) == [("db", "xtrabackup", "0215")]
    inst = spark.createDataFrame([("c1", "Slave", "b"), ("c1", "Masterbackup", "a"), ("c2", "Slave", "z"), ("c2", "Slave", "y"), ("c3", "Master", "m")],
                                 "type string, role string, host string")
    assert rows(retention.prefer_role(inst, ["type"], "role", ["Masterbackup", "Slave"], ["host"], ["host"])) == [
        ("c1", "Masterbackup", "a"), ("c2", "Slave", "y")]
    chunks = spark.createDataFrame([("t1", "Succ", 5), ("t1", "Fail", 3), ("t2", "Succ", 4), ("t3", "Init", 0)], "task string, status string, n long")
    assert rows(retention.status_rollup(chunks, ["task"], "status", "n")) == [("t1", "Fail", 2, 8), ("t2", "Succ", 1, 4), ("t3", "Succ", 1, 0)]
    assert rows(retention.run_summary(chunks, [], "status")) == [(2, 1, 1)]


def test_catalogue_plans(spark, rows):
    info = spark.createDataFrame([
        ("db", "xtrabackup", "online", 9, [0, 7, 365, 3650], "online"), ("db", "mydumper", "ONLINE", 4, None, "online"),
        ("db", "mysqldump", "offline", 9, None, "online"), ("gone", "xtrabackup", "online", 9, None, "offline"),
    ], "type string, mode string, mode_state string, weekday int, clear_rule array<int>, state string")
    led = spark.createDataFrame([
        ("DB-20190220-XTRABACKUP", "Fail", "2019-02-20 01:00:00"), ("DB-20190220-XTRABACKUP", "Succ", "2019-02-20 02:00:00"),
    ], "task_id string, backup_status string, start_time string")
    assert rows(backup_catalogue.due_tasks(info, led, day("0220"))) == [("db", "xtrabackup", "DB-20190220-XTRABACKUP", "none")]
    assert rows(backup_catalogue.due_tasks(info, led, day("0221"))) == [
        ("db", "mydumper", "DB-20190221-MYDUMPER", "start"), ("db", "xtrabackup", "DB-20190221-XTRABACKUP", "start")]
    both = ledger(spark, ["0214", "0215", "0219"]).unionByName(ledger(spark, ["0214", "0215", "0219"], "mydumper"))
    ids = both.withColumn("task_id", F.concat("mode", "task_id"))
    assert rows(backup_catalogue.clear_plan(info, ids, day("0220")), "task_id") == [("mydumper0215",), ("xtrabackup0215",)]


def test_null_group_keeps_its_only_copies(spark, rows):
    df = spark.createDataFrame([(None, dt.date(2020, 1, d), d) for d in (1, 2, 3)], "g string, day date, id long")
    out = retention.tiered_retention(df, ["g"], "day", "id", dt.date(2021, 1, 1), None)
    assert rows(out, "id", "kept") == [(1, True), (2, False), (3, True)]
