import pytest
from pyspark.sql import functions as F

from fleetloom.operators import config
from fleetloom.sources.text import scan_kv_lines

PERSON = [
    ("threads_running", "20000", "10.0.0.10", 65536, "offline"), ("threads_running", "30000", "10.0.0.10", 10000, "online"),
    ("archive_count", "1000", "10.0.0.12", 10000, "online"),
]
COMMON = [("archive_count", "20000", "online"), ("threads_running", "1000", "online"), ("repl_time", "3", "online"), ("old", "1", "offline")]
KEYS = ("key", "server_host", "server_port")


def resolve(spark, asked, **more):
    person = spark.createDataFrame(more.pop("person", PERSON), "key string, value string, server_host string, server_port int, state string")
    common = spark.createDataFrame(more.pop("common", COMMON), "key string, value string, state string")
    req = spark.createDataFrame(asked, "key string, server_host string, server_port int")
    out = config.resolve_config(req, person, common, person_keys=KEYS, **more)
    return {(r["key"], r["server_host"], r["server_port"]): (r["value"], r["source"], r["missing"]) for r in out.collect()}


def test_recorded_overrides(spark):
    got = resolve(spark, [
        ("archive_count", "10.0.0.12", 10000), ("archive_count", "10.0.0.13", 10000), ("threads_running", "10.0.0.10", 65536),
        ("threads_running", "10.0.0.10", 10000), ("old", "x", 1), ("nothing", "x", 1),
    ])
    assert got[("archive_count", "10.0.0.12", 10000)] == ("1000", "person", False)
    assert got[("archive_count", "10.0.0.13", 10000)] == ("20000", "common", False)
    assert got[("threads_running", "10.0.0.10", 65536)] == ("1000", "common", False)
    assert got[("threads_running", "10.0.0.10", 10000)] == ("30000", "person", False)
    assert got[("old", "x", 1)] == (None, "none", True) == got[("nothing", "x", 1)]


def test_local_file_and_empty_value(spark):
    lines = spark.createDataFrame([("[conf]",), ("cpu_percent=85",), ("archive_count = 7",), ("# x=1",)], "value string")
    local = scan_kv_lines(lines)
    got = resolve(spark, [("cpu_percent", "h", 1), ("archive_count", "h", 1)], local=local, common=[("archive_count", "", "online")])
    assert got[("cpu_percent", "h", 1)] == ("85", "local", False)
    assert got[("archive_count", "h", 1)] == ("7", "local", False)


def test_host_tier(spark):
    host = spark.createDataFrame([("archive_count", "h", "55", "online")], "key string, server_host string, value string, state string")
    got = resolve(spark, [("archive_count", "h", 1), ("archive_count", "10.0.0.12", 10000)], host_wide=host)
    assert got[("archive_count", "h", 1)] == ("55", "host", False)
    assert got[("archive_count", "10.0.0.12", 10000)] == ("1000", "person", False)


def test_two_rows_for_a_key_are_an_error(spark):
    with pytest.raises(Exception, match="more than one config row"):
        resolve(spark, [("archive_count", "h", 1)], common=[("archive_count", "1", "online"), ("archive_count", "2", "online")])


@pytest.mark.parametrize("limit", [100_000, 0])
def test_script_state(spark, rows, limit):
    hosts = spark.createDataFrame([("a",), ("b",)], "server_host string")
    common = spark.createDataFrame([
        ("top.sh", "1 MINUTE", "", "on", "online"), ("ps.sh", "1 MINUTE", "", "off", "online"), ("x.sh", "1 DAY", "", "on", "online"),
        ("gone.sh", "1 MINUTE", "", "on", "offline"),
    ], "basename string, frequency string, time_interval string, running_state string, state string")
    person = spark.createDataFrame([
        ("a", "top.sh", "1 MINUTE", "off", "online"), ("b", "ps.sh", "1 MINUTE", "on", "offline"),
    ], "server_host string, basename string, frequency string, running_state string, state string")
    assert rows(config.resolve_script_state(hosts, common, person, "1 MINUTE", max_broadcast_rows=limit)) == [
        ("a", "ps.sh", "off", "common"), ("a", "top.sh", "off", "person"), ("b", "ps.sh", "off", "common"), ("b", "top.sh", "on", "common"),
    ]


def test_script_state_plan_does_not_grow(spark):
    """As many scripts as you like make the same plan; a list beyond the bound is shuffled, the hosts over several groups."""
    hosts = spark.range(40_000).select(F.col("id").alias("server_host"))
    listed = lambda n: spark.range(n).select(F.concat(F.lit("s"), "id").alias("basename"), F.lit("1 MINUTE").alias("frequency"), F.lit("on").alias("running_state"), F.lit("online").alias("state"))
    none = listed(1).filter("basename = ''").withColumn("server_host", F.lit(0).cast("long"))
    plans = [config.resolve_script_state(hosts, listed(n), none, "1 MINUTE") for n in (2, 3000)]
    sizes = [len(p._jdf.queryExecution().executedPlan().toString()) for p in plans]
    assert sizes[1] < sizes[0] + 200
    wide = config.resolve_script_state(hosts, listed(3), none, "1 MINUTE", max_broadcast_rows=2)
    assert wide.count() == 120_000
    assert config.resolve_script_state(hosts, listed(3).filter("basename = ''"), none, "1 MINUTE").count() == 0


def test_config_map(spark):
    df = spark.createDataFrame([("h", "a", "1"), ("h", "b", "2"), ("g", "a", "3")], "host string, key string, value string")
    got = {r["host"]: r["conf"] for r in config.config_map(df, ["host"]).collect()}
    assert got == {"h": {"a": "1", "b": "2"}, "g": {"a": "3"}}
    assert {r["host"]: r["conf"] for r in config.config_map(df, ["host"], wanted=["b"]).collect()} == {"h": {"b": "2"}}
