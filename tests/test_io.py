"""Upserts, text formats, exports and tables on disk."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import upserts
from fleetloom.sources import tables, text

SCHEMA = "ip string, port int, a long, b string"


def target(spark):
    return spark.createDataFrame([("h", 1, 10, "x"), ("h", 2, 20, "y")], SCHEMA)


def batch(spark):
    return spark.createDataFrame([("h", 1, 11, 1), ("h", 1, 12, 2), ("h", 3, 30, 1)], "ip string, port int, a long, seq int")


def test_replace_takes_defaults_not_old_values(spark, rows):
    out = upserts.upsert_replace(target(spark), batch(spark), ["ip", "port"], ["seq"], {"b": ""})
    assert rows(out) == [("h", 1, 12, ""), ("h", 2, 20, "y"), ("h", 3, 30, "")]
    again = upserts.upsert_replace(out, batch(spark), ["ip", "port"], ["seq"], {"b": ""})
    assert rows(again) == rows(out)
    assert rows(tables.load_replace(target(spark), batch(spark), ["ip", "port"], ["seq"])) == [("h", 1, 12, None), ("h", 2, 20, "y"), ("h", 3, 30, None)]


def test_partial_keeps_the_rest(spark, rows):
    out = upserts.upsert_partial(target(spark), batch(spark), ["ip", "port"], ["a"], ["seq"])
    assert rows(out) == [("h", 1, 12, "x"), ("h", 2, 20, "y"), ("h", 3, 30, None)]
    assert rows(upserts.upsert_partial(target(spark), batch(spark), ["ip", "port"], ["b"], ["seq"]).filter("port = 1")) == [("h", 1, 10, "x")]


SECTION = """Started dump at: 2021-05-06 01:02:03
SHOW MASTER STATUS:
\tLog: binlog.000006
\tPos: 1200345
\tGTID:

SHOW SLAVE STATUS:
\tHost: 10.0.0.12
\tLog: binlog.000007
\tPos: 9800456
\tGTID:
Finished dump at: 2021-05-06 01:02:09
"""


@pytest.mark.parametrize("io,sql,want", [
    ("Yes", "Yes", ("up", 3307, "binlog.000007", 9800456)), ("Yes", "No", ("src", 3306, "binlog.000006", 1200345)), (None, None, ("src", 3306, "binlog.000006", 1200345)),
])
def test_section_metadata(spark, tmp_path, io, sql, want):
    (tmp_path / "metadata").write_text(SECTION)
    files = text.read_whole(spark, str(tmp_path))
    status = lambda v: F.lit(v).cast("string")
    row = text.parse_section_metadata(files, "text", F.lit("src"), F.lit(3306), status(io), status(sql), F.lit("up"), F.lit(3307), ["path"]).first()
    assert row[1:5] == want and row["path"].endswith("/metadata")
    assert (row["start_time"], row["end_time"]) == (dt.datetime(2021, 5, 6, 1, 2, 3), dt.datetime(2021, 5, 6, 1, 2, 9))


INFO = """uuid = 6f1d0c52-0000-4000-8000-00000000a001
name = 
tool_name = innobackupex
start_time = 2019-02-14 09:59:01
end_time = 2019-02-14 09:59:14
lock_time = 0
binlog_pos = filename 'binlog.000042', position '7654321'
format = tar
"""


def test_info_metadata(spark):
    df = spark.createDataFrame([(INFO,), ("start_time = 1970-01-01 00:00:00\nname = x\n",)], "text string")
    got = [tuple(r) for r in text.parse_info_metadata(df, "text", F.lit("h"), F.lit(10000)).collect()]
    assert got[0] == ("h", 10000, "binlog.000042", 7654321, dt.datetime(2019, 2, 14, 9, 59, 1), dt.datetime(2019, 2, 14, 9, 59, 14))
    assert got[1] == ("h", 10000, None, None, None, None)


def test_log_lines(spark):
    lines = [
        "[2019-02-21 11:45:04 f.py]:=== START.", "\x1b[0;35m[2019-02-19 17:07:33] === START.\x1b[0m", "\x1b[0m[2019-02-19 17:07:33] [db-1]is [SUCC], exit\x1b[0m",
        "[2019-02-19 17:07:33] [f.py] [77-MainThread] [INFO] [done]", "free text", "[2019-13-19 17:07:33] x", "",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = {r["i"]: (str(r["ts"]) if r["ts"] else None, r["file"], r["level"], r["message"], r["rejected"]) for r in text.scan_log_lines(df).collect()}
    assert got[0] == ("2019-02-21 11:45:04", "f.py", None, "=== START.", None)
    assert got[1] == ("2019-02-19 17:07:33", None, None, "=== START.", None)
    assert got[2] == ("2019-02-19 17:07:33", None, None, "[db-1]is [SUCC], exit", None)
    assert got[3] == ("2019-02-19 17:07:33", "f.py", "INFO", "done", None)
    assert got[4][3:] == (None, "free text") and got[5][3:] == (None, "[2019-13-19 17:07:33] x") and got[6][3:] == (None, "")


def test_kv_lines(spark, rows):
    df = spark.createDataFrame([("[conf]",), ("a=1",), (" b = x = y ",), ("# c=1",), ("",)], "value string")
    assert rows(text.scan_kv_lines(df)) == [("a", "1"), ("b", "x = y")]


def test_export_manifest_and_restore(spark, tmp_path, rows):
    df = spark.range(103).select("id", F.when(F.col("id") < 100, "big").otherwise("small").alias("schema"))
    manifest = tables.export_chunked(df, "schema", str(tmp_path / "e"), 10)
    assert manifest.agg(F.max("file_rows")).first()[0] <= 10
    assert rows(manifest.groupBy("schema").agg(F.sum("file_rows"))) == [("big", 100), ("small", 3)]
    only = tables.export_chunked(df, "schema", str(tmp_path / "o"), 10, ["small"])
    assert rows(only.select("schema").distinct()) == [("small",)]
    again = tables.export_chunked(df, "schema", str(tmp_path / "o"), 10, ["big"])
    assert rows(again.select("schema").distinct()) == [("big",)]
    led = spark.createDataFrame([("i", dt.date(2024, 1, 1), str(tmp_path / "e"), "Succ"), ("i", dt.date(2024, 1, 2), str(tmp_path / "o"), "Fail")],
                                "instance string, date date, path string, status string")
    usable = F.col("status") == "Succ"
    assert tables.restore_latest(spark, led, "instance", "i", ["date"], "path", usable).count() == 103
    with pytest.raises(LookupError):
        tables.restore_latest(spark, led, "instance", "j", ["date"], "path", usable)


def test_route_by_date(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 31)), (2, dt.datetime(2023, 12, 1)), (3, dt.datetime(2024, 1, 31))], "id long, ts timestamp_ntz")
    back = tables.route_by_date(df, "shop_db.orders", "ts", str(tmp_path / "r"))
    assert rows(back, "shard_schema", "shard_table", "id") == [
        ("shop_2023_db", "orders_1201", 2), ("shop_2024_db", "orders_0131", 1), ("shop_2024_db", "orders_0131", 3)]


def test_ensure_table(spark, tmp_path):
    df = target(spark)
    assert tables.ensure_table(df, "made_once", str(tmp_path / "t"), ["port"]) is True
    assert tables.ensure_table(df, "made_once", str(tmp_path / "t")) is False
    assert sorted(spark.table("made_once").columns) == sorted(df.columns) and spark.table("made_once").count() == 0


def test_scan_prunes_and_pushes_down(spark):
    df = tables.scan_table(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_orderkey"], F.col("l_quantity") > 45)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_unknown_times(spark, rows):
    df = spark.createDataFrame([(1, dt.datetime(1970, 1, 1), dt.date(1970, 1, 1)), (2, dt.datetime(2020, 1, 1), dt.date(2020, 1, 1))], "i int, t timestamp_ntz, d date")
    null = tables.unknown_to_null(df, ["t", "d"])
    assert rows(null) == [(1, None, None), (2, dt.datetime(2020, 1, 1), dt.date(2020, 1, 1))]
    assert rows(tables.null_to_unknown(null, ["t", "d"])) == rows(df)


def test_collector_whitelists(spark, rows):
    from fleetloom import whitelists
    from fleetloom.operators.tables import exclude_names, null_defaults, pivot_whitelist

    raw = spark.createDataFrame([("h", "Slow_queries", "5"), ("h", "Key_read_requests", "7"), ("h", "Uptime", "9"), ("h", "slow_queries", "6")], "ip string, n string, v string")
    row = pivot_whitelist(raw, ["ip"], "n", "v", whitelists.STATUS, "f").first()
    assert (row["fslow_queries"], row["fkey_read_requests"], row["fqueries"]) == ("5", "7", None) and len(row) == 55
    info = spark.createDataFrame([("shop", None, None), ("sys", "x", "1")], "table_schema string, row_format string, engine string")
    kept = exclude_names(info, "table_schema", whitelists.SYSTEM_SCHEMAS)
    wanted = {c: whitelists.TABLE_INFO_DEFAULTS[c] for c in info.columns}
    assert rows(null_defaults(kept, wanted)) == [("shop", "0", "")]
