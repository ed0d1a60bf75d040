import datetime as dt

from pyspark.sql import functions as F

from fleetloom.operators import rates
from fleetloom.operators.alarms import converge_time
from fleetloom.operators.tables import pivot_whitelist
from fleetloom.plans.alarm_path import converged_rate_alarms, rate_alarms

SCHEMA = "ip string, port int, slot timestamp_ntz, written timestamp_ntz, slow long, com long"
KEYS = ["ip", "port"]


def at(minute, second=0):
    return dt.datetime(2019, 2, 14, 10, 0) + dt.timedelta(minutes=minute, seconds=second)


def samples(spark):
    return spark.createDataFrame([
        ("a", 1, at(0), at(0, 2), 100, 10), ("a", 1, at(1), at(1, 2), 700, 70), ("a", 1, at(2), at(2, 12), 1400, 130),
        ("a", 1, at(4), at(4, 2), 9000, 200),   # no sample at minute 3
        ("a", 1, at(5), at(5, 2), 60, 260),     # restart
        ("b", 1, at(0), at(0, 2), 0, 5), ("b", 1, at(1), at(1, 2), 60, 65),   # zero on one side
        ("a", 2, at(0), at(0, 2), 5, 5), ("a", 2, at(1), at(0, 2), 65, 65),   # written at the same moment
    ], SCHEMA)


def test_counter_rate_abs(spark, rows):
    got = rows(rates.counter_rate(samples(spark), KEYS, "slot", "written", ["slow"]))
    assert got == sorted([
        ("a", 1, at(1), 10.0), ("a", 1, at(2), 10.0), ("a", 1, at(5), 149.0), ("a", 2, at(1), None),
    ], key=repr)


def test_counter_rate_reset_aware(spark, rows):
    got = rows(rates.counter_rate(samples(spark), KEYS, "slot", "written", ["slow"], mode="reset_aware").filter("ip = 'a' and port = 1"))
    assert got == sorted([
        ("a", 1, at(1), False, 10.0), ("a", 1, at(2), False, 10.0), ("a", 1, at(5), True, None),
    ], key=repr)


def test_rate_does_not_depend_on_slicing(spark, rows):
    s = samples(spark)
    plain = rows(rates.with_step_before(s, KEYS, "slot", ["slow"], 60).select(*KEYS, "slot", "paired", "before_slow"))
    for steps in (1, 2, 3):
        assert rows(rates.with_step_before(s.repartition(7), KEYS, "slot", ["slow"], 60, steps).select(*KEYS, "slot", "paired", "before_slow")) == plain


def test_no_result_markers(spark, rows):
    s = samples(spark)
    r = rates.counter_rate(s, KEYS, "slot", "written", ["slow"])
    marks = rates.no_result_markers(s, r, KEYS, "slot")
    assert marks.count() + r.count() == s.count()
    assert {m["marker"] for m in marks.collect()} == {"NO_RESULT"}


def test_throughput_sums_rates(spark, rows):
    got = rows(rates.throughput(samples(spark), KEYS, "slot", "written", {"tps": ["slow", "com"]}).filter("ip = 'b'"))
    assert got == [("b", 1, at(1), 2.0)]


def test_busy_and_load(spark):
    df = spark.createDataFrame([(30.0, 20.0, 50.0), (0.0, 0.0, 0.0)], "u double, s double, i double")
    assert [r[0] for r in df.select(rates.busy_ratio([F.col("u"), F.col("s")], F.col("i"))).collect()] == [50.0, None]
    load = rates.load_breach(F.lit(5.6), F.lit(8), F.lit(70), F.lit(20))
    assert spark.range(1).select(load).first()[0] is False
    assert spark.range(1).select(rates.load_breach(F.lit(5.7), F.lit(8), F.lit(70), F.lit(20))).first()[0] is True
    assert spark.range(1).select(rates.load_breach(F.lit(20.5), F.lit(80), F.lit(70), F.lit(20))).first()[0] is True


def test_alarm_path_from_raw_status(spark, rows):
    raw = spark.createDataFrame([
        ("a", 1, at(m), at(m, 2), name, v) for m, v1 in ((0, "100"), (1, "760"), (2, "820")) for name, v in (("Slow_queries", v1), ("Uptime", "9"))
    ], "ip string, port int, slot timestamp_ntz, written timestamp_ntz, variable_name string, value string")
    wide = pivot_whitelist(raw, [*KEYS, "slot", "written"], "variable_name", "value", ["Slow_queries"], "f")
    wide = wide.withColumn("slow", F.col("fslow_queries").try_cast("long"))
    person = spark.createDataFrame([], "key string, ip string, port int, value string, state string")
    common = spark.createDataFrame([("mysql_slow_queries", "10", "online")], "key string, value string, state string")
    out = rate_alarms(wide, person, common, keys=KEYS, slot="slot", written="written", counter="slow", config_key="mysql_slow_queries", step_seconds=60, alarm_id="110")
    got = rows(out, "ip", "port", "slot", "slow_rate", "threshold", "alarm_id", "range_begin")
    assert got == [("a", 1, at(1), 11.0, 10.0, "110", at(0))]
    assert converged_rate_alarms(out, KEYS, "slot", 300).count() == 1
    assert converge_time(out, KEYS, "slot", ["alarm_id"], 60).count() == 1
