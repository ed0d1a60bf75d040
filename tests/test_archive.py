import datetime as dt
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import archive
from fleetloom.operators.tables import age_limit, key_range, older_than
from fleetloom.plans.archive_run import archive_partitioned, archive_tasks, run_archive

TODAY = dt.date(2020, 3, 1)


@pytest.mark.parametrize("n,sizes", [(0, []), (1, [1]), (9, [9]), (10, [10]), (11, [10, 1]), (30, [10, 10, 10])])
def test_chunks_at_the_edges(spark, n, sizes):
    df = spark.range(n).select((F.col("id") * 3 + 5).alias("k")).repartition(3)
    got = sorted(tuple(r) for r in archive.keyset_chunks(df, ["k"], 10).collect())
    assert [c[3] for c in got] == sizes
    assert [c[0] for c in got] == list(range(len(sizes)))
    assert all(a[2] < b[1] for a, b in zip(got, got[1:]))
    # The closed ranges take exactly the rows of their chunk.
    for _, first, last, rows in got:
        assert key_range(df, "k", first, last).count() == rows


def test_composite_key_chunks(spark):
    df = spark.range(25).select((F.col("id") % 5).alias("a"), F.col("id").alias("b"))
    got = sorted((r["chunk_no"], tuple(r["first_key"]), tuple(r["last_key"]), r["chunk_rows"]) for r in archive.keyset_chunks(df, ["a", "b"], 10).collect())
    assert got == [(0, (0, 0), (1, 21), 10), (1, (2, 2), (3, 23), 10), (2, (4, 4), (4, 24), 5)]


def times(spark):
    return spark.createDataFrame([
        (1, dt.datetime(2020, 1, 30, 23, 59, 59)), (2, dt.datetime(2020, 1, 31)), (3, None), (4, dt.datetime(2019, 1, 1)), (5, dt.datetime(2020, 2, 29)),
    ], "id long, at timestamp_ntz")


def test_older_than_is_strict_for_every_type(spark):
    df = times(spark).withColumns({"d": F.to_date("at"), "s": F.date_format("at", "yyyy-MM-dd HH:mm:ss"), "n": F.unix_timestamp("at")})
    df = df.withColumn("i", F.col("n").cast("int"))
    old = lambda c: sorted(r["id"] for r in older_than(df, c, TODAY, 30).collect())
    assert old("at") == old("d") == old("s") == [1, 4]
    # Numbers are compared with 00:00:01 of the day, so its first second is old too.
    assert old("n") == old("i") == [1, 2, 4]
    with pytest.raises(TypeError):
        age_limit(spark.createDataFrame([(True,)], "b boolean"), "b", TODAY, 1)


def test_split_is_complementary(spark):
    split = archive.archive_split(times(spark), "at", TODAY, 30, ["id"], 1, "task")
    kept, old = {r["id"] for r in split.kept.collect()}, {r["id"] for r in split.archived.collect()}
    assert kept == {2, 3, 5} and old == {1, 4}
    assert {(r["side"], r["id"]) for r in split.sided.collect()} == {("kept", i) for i in kept} | {("archived", i) for i in old}
    assert sorted((r["task_id"], r["first_key"], r["chunk_rows"], r["exec_status"]) for r in split.chunks.collect()) == [
        ("task", 1, 1, "Succ"), ("task", 4, 1, "Succ")]


def test_run_archive_writes_both_sides(spark, tmp_path):
    task = run_archive(times(spark), "at", TODAY, 30, ["id"], 10, str(tmp_path), "t1").collect()
    assert [tuple(r) for r in task] == [("t1", "Succ", 1, 2)]
    back = spark.read.parquet(f"{tmp_path}/rows")
    assert back.count() == 5 and back.filter("side = 'archived'").count() == 2


def test_bounds_of_nothing(spark):
    assert tuple(archive.key_bounds(times(spark).filter("id > 99"), "id").first()) == (None, None, 0)


def test_key_profile(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "b", 2)], "id long, name string, maybe int")
    assert rows(archive.key_profile(df, ["id", "name", "maybe"]), "column_name", "column_type", "row_count", "distinct_values", "nulls", "usable") == [
        ("id", "bigint", 3, 3, 0, True), ("maybe", "int", 3, 2, 1, False), ("name", "string", 3, 2, 0, False)]


def test_key_profile_tells_microseconds_apart(spark, rows):
    df = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id / 1000000.0) AS at, if(id = 1, NULL, map('k', id div 2)) AS m FROM range(4)")
    got = rows(archive.key_profile(df, ["at", "m"]), "column_name", "column_type", "row_count", "distinct_values", "nulls", "usable")
    assert got == [("at", "timestamp_ntz", 4, 4, 0, True), ("m", "map<string,bigint>", 4, 2, 1, False)]
    assert rows(archive.key_profile(df.limit(0), ["id"])) == [("id", "bigint", 0, 0, 0, True)]


def test_retire_partitions_drops_only_old_ones(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2020-0{m}-01") for i, m in enumerate([1, 1, 2, 3])], "id long, day string")
    df.write.option("path", str(tmp_path / "t")).partitionBy("day").saveAsTable("retire_me")
    assert archive.retire_partitions(spark, "retire_me", "day", dt.date(2020, 2, 1)) == ["2020-01-01"]
    assert sorted(r["id"] for r in spark.table("retire_me").collect()) == [2, 3]
    assert archive.retire_partitions(spark, "retire_me", "day", dt.date(2020, 2, 1)) == []


def test_retire_run_reports_what_it_drops(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["2020-01-01", "2020-01-01", "2020-01-09", "2020-02-01", "other", "2020-1-3"])], "id long, day string")
    df.repartition(3).write.option("path", str(tmp_path / "t")).partitionBy("day").saveAsTable("retire_run")
    spark.sql("ALTER TABLE retire_run ADD PARTITION (day = '2019-12-31')")
    report = archive.retire_run(spark, "retire_run", "day", dt.date(2020, 2, 1), page=2)
    assert rows(report, "value", "row_count") == [("2019-12-31", 0), ("2020-01-01", 2), ("2020-01-09", 1)]
    # What names no date in full stays, and so does the threshold itself.
    assert rows(spark.table("retire_run"), "id") == [(3,), (4,), (5,)]
    assert all((r["size_mb"] > 0) == (r["files"] > 0) == (r["row_count"] > 0) for r in report.collect())
    assert archive.retire_run(spark, "retire_run", "day", dt.date(2020, 2, 1)).collect() == []


def test_sizes_come_from_footers(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("part"))
    df.write.partitionBy("part").parquet(str(tmp_path / "t"))
    sizes = archive.partition_sizes(spark.read.parquet(str(tmp_path / "t")).filter("part > 0"), "part")
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and "PartitionFilters: [isnotnull(part" in plan
    assert sorted((r["value"], r["row_count"]) for r in sizes.collect()) == [("1", 333), ("2", 333)]


def test_unique_keys_are_minimal(spark):
    rows = [(i, i // 7, i % 7, 1, None if i == 3 else i, i // 2, i % 2) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a long, b long, one long, holes long, c long, d long")
    found = archive.unique_keys(df, df.columns, 3)
    distinct = lambda s: len({tuple(r[df.columns.index(c)] for c in s) for r in rows}) == len(rows)
    want = []
    for size in (1, 2, 3):
        want += [s for s in combinations([c for c in df.columns if c != "holes"], size) if distinct(s) and not any(set(k) <= set(s) for k in want)]
    assert sorted(found) == sorted(want) and ("a", "b") in found
    # One repeated row among many is seen, though the estimate can't see it.
    more = df.union(df.limit(1))
    assert archive.unique_keys(more, ["id", "a", "b"], 3) == []
    assert archive.unique_keys(df.limit(0), ["id"], 2) == []


def test_unique_keys_counts_all_groups_only_where_a_slice_has_no_repeat(spark, monkeypatch):
    calls, repeats = [], archive._repeats
    monkeypatch.setattr(archive, "_repeats", lambda df, s: calls.append(s) or repeats(df, s))
    df = spark.range(20_000).select("id", F.when(F.col("id") % 20 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("near"))
    assert archive.unique_keys(df, ["id", "near"], 1) == [("id",)]
    assert calls == [("id",), ("id",), ("near",)]


def test_retirable_parts_compares_dates_not_text(spark, rows):
    parts = spark.createDataFrame([("p1", "'2019-12-01'"), ("p2", "'2020-2-1'"), ("p3", "MAXVALUE"), ("p4", "'2020-10-01'")], "name string, bound string")
    assert rows(archive.retirable_parts(parts, "bound", dt.date(2020, 3, 1)), "name") == [("p1",), ("p2",)]


def test_footprint(spark, rows):
    parts = spark.createDataFrame([("s", "t", 1048576, 1048576, 5), ("s", "t", 0, 524288, 1)], "s string, t string, d long, i long, n long")
    assert rows(archive.footprint(parts, ["s", "t"], "d", "i", "n")) == [("s", "t", 2.5, 6, 2)]


def test_partitioned_table_is_copied_then_dropped(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, dt.date(2020, 1, 30)), (3, dt.date(2020, 1, 31)), (4, dt.date(2020, 2, 9))], "id long, day date")
    df.write.option("path", str(tmp_path / "t")).partitionBy("day").saveAsTable("archive_me")
    assert archive_partitioned(spark, "archive_me", "day", TODAY, 30, str(tmp_path / "out")) == ["2020-01-01", "2020-01-30"]
    assert sorted(r["id"] for r in spark.table("archive_me").collect()) == [3, 4]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "archived")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        archive_partitioned(spark, "archive_me", "id", TODAY, 30, str(tmp_path / "out"))


def test_archive_tasks(spark, rows):
    info = spark.createDataFrame([
        ("10.0.0.12", 10000, "shop.orders", "created", 30, "y", "online"), ("10.0.0.13", 10000, "shop.logs", "at", 7, "N", "online"),
        ("10.0.0.13", 10000, "shop.old", "at", 7, "N", "offline"),
    ], "server_host string, server_port int, table string, column string, keep_days int, backup_status string, state string")
    person = spark.createDataFrame([("archive_count", "1000", "10.0.0.12", 10000, "online")], "key string, value string, server_host string, server_port int, state string")
    common = spark.createDataFrame([("archive_count", "20000", "online")], "key string, value string, state string")
    got = archive_tasks(info, person, common, dt.datetime(2019, 1, 2, 3, 4, 5))
    assert rows(got, "task_id", "table_schema", "table_name", "backup", "chunk_rows") == [
        ("100012_10000_20190102030405", "shop", "orders", True, 1000), ("100013_10000_20190102030405", "shop", "logs", False, 20000)]
