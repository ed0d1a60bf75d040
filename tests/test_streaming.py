"""Streams taken in several runs from one checkpoint, against the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from fleetloom.operators import alarms
from fleetloom.operators.rates import counter_rate
from fleetloom.streaming import keyed, known, minutes

ZERO = dt.datetime(2024, 1, 1)


def at(seconds):
    return ZERO + dt.timedelta(seconds=seconds)


def add(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def rates_of(stream, late_seconds=0):
    return minutes.stream_rates(stream, keys=["k"], slot="slot", written="written", counters=["c"], step_seconds=60, late_seconds=late_seconds)


def test_minute_slots_over_two_runs(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "k string, ts timestamp_ntz"
    for part in ([("a", at(1)), ("a", at(30)), ("b", at(70))], [("a", at(50)), ("a", at(400))], []):
        s = add(spark, src, part, schema) if part else s
        minutes.run_to_folder(minutes.minute_slots(minutes.file_stream(spark, src, s), "ts", ["k"], "1 minute", "1 minute"), out, cp)
    # The sample at 50 s came within the minute that is waited for.
    assert rows(spark.read.parquet(out), "k", "samples") == [("a", 3), ("b", 1)]


def test_cadences_agree_on_late_samples(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "k string, ts timestamp_ntz"
    parts = [[("a", at(s)) for s in (0, 1, 1, 59, 61, 200, 400)] + [("b", at(130))], [("a", at(350)), ("a", at(2))], [("a", at(2000)), (None, at(650))], [("a", at(4000))]]
    for part in parts:
        s = add(spark, src, part, schema)
        found = minutes.run_cadences(minutes.file_stream(spark, src, s), "ts", ["k"], ["1 second", "1 minute", "10 minutes"], str(tmp_path / "out"), "1 minute").collect()
    start = lambda r: int((r["slot_start"] - at(0)).total_seconds())
    got = {c: sorted(((r["k"], start(r), r["samples"]) for r in found if r["cadence"] == c), key=repr) for c in ("1 second", "1 minute", "10 minutes")}
    # 350 s came within the minute that is waited for, 2 s came after it and counts nowhere; what is not closed is not there yet.
    kept = [("a", x) for x in (0, 1, 1, 59, 61, 200, 350, 400, 2000)] + [("b", 130), (None, 650)]
    count = lambda slots: sorted(((k, x, slots.count((k, x))) for k, x in set(slots)), key=repr)
    by = lambda size: count([(k, x // size * size) for k, x in kept])
    assert got["1 second"] == by(1)
    assert got["1 minute"] == [r for r in by(60) if r[1] != 1980]
    assert got["10 minutes"] == [r for r in by(600) if r[1] < 600]


def test_chained_slots_in_one_query(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in ([("a", at(1)), ("a", at(70)), ("b", at(599))], [("a", at(100)), ("a", at(1900))]):
        s = add(spark, src, part, "k string, ts timestamp_ntz")
        minutes.run_to_folder(minutes.chained_slots(minutes.file_stream(spark, src, s), "ts", ["k"], ["1 second", "1 minute", "10 minutes"], "10 minutes"), out, cp)
    assert sorted((r["k"], r["samples"]) for r in spark.read.parquet(out).collect()) == [("a", 3), ("b", 1)]


def test_ingest_resumes_and_repeats_nothing(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in ([(1,), (2,)], [(3,)]):
        s = add(spark, src, part, "id long")
        for _ in range(2):
            minutes.run_batches(minutes.incremental_source(spark, src, s), minutes.stream_ingest(out), cp)
    assert sorted(r["id"] for r in spark.read.option("basePath", out).parquet(out).collect()) == [1, 2, 3]


def test_first_segment_is_respected(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    (tmp_path / "src").mkdir()
    for n in (1, 2, 3):
        (tmp_path / "src" / f"binlog.00000{n}").write_text(f"row{n}\n")
    stream = minutes.incremental_source(spark, src, "value string", "binlog.000002", fmt="text")
    minutes.run_batches(stream, minutes.stream_ingest(out), cp)
    got = spark.read.option("basePath", out).parquet(out)
    assert sorted((r["segment"], r["value"]) for r in got.collect()) == [("binlog.000002", "row2"), ("binlog.000003", "row3")]


def test_rate_alarm_same_as_batch(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "k string, slot timestamp_ntz, written timestamp_ntz, c long"
    parts = [[("a", at(0), at(1), 100)], [("a", at(60), at(61), 1000), ("b", at(60), at(61), 5)], [("a", at(120), at(121), 1060), ("b", at(120), at(121), 6005)]]
    limits = lambda session: session.createDataFrame([("a", 10.0), ("b", 50.0)], "k string, threshold double")
    each = minutes.alarm_batches(out, limits, keys=["k"], slot="slot", counter="c", threshold="threshold", step_seconds=60, alarm_id="110", end=F.col("slot"))
    for part in parts:
        s = add(spark, src, part, schema)
        minutes.run_batches(rates_of(minutes.file_stream(spark, src, s)), each, cp, closing=False)
    got = rows(spark.read.option("basePath", out).parquet(out), "k", "slot", "c_rate")
    whole = counter_rate(spark.read.parquet(src), ["k"], "slot", "written", ["c"], 60).join(limits(spark), "k").filter("c_rate > threshold")
    assert got == rows(whole, "k", "slot", "c_rate") == [("a", at(60), 15.0), ("b", at(120), 100.0)]


def heartbeats(spark, src, cp, parts, **options):
    schema = "host string, task string, ts timestamp_ntz, is_done boolean"
    for part in parts:
        s = add(spark, src, part, schema)
        query = known.run_last_known(minutes.file_stream(spark, src, s), ["host", "task"], "ts", ["is_done"], cp, **options)
    return query


def seen(spark, cp):
    zero = dt.datetime(1970, 1, 1)
    return sorted((r["task"], zero + dt.timedelta(microseconds=r["last_us"]), r["is_done"]) for r in known.known_now(spark, cp).collect())


def test_running_state_takes_late_reports_in_order(spark, tmp_path):
    src, cp = (str(tmp_path / x) for x in ("src", "cp"))
    heartbeats(spark, src, cp, [[("h", "t", at(10), True), ("h", "u", at(5), False)], [("h", "t", at(8), False), ("h", "u", at(9), True)]])
    assert seen(spark, cp) == [("t", at(10), True), ("u", at(9), True)]


def test_running_state_keeps_a_value_that_a_later_report_lacks(spark, tmp_path):
    src, cp = (str(tmp_path / x) for x in ("src", "cp"))
    parts = [[("h", "t", at(10), None), ("h", "u", at(3), True), ("h", "u", at(4), None)], [("h", "t", at(8), False), ("h", "t", at(8), True), ("h", "t", None, False)]]
    heartbeats(spark, src, cp, parts)
    assert seen(spark, cp) == [("t", at(10), True), ("u", at(4), True)]


def test_running_state_batch_costs_its_own_keys_and_repeats_nothing(spark, tmp_path):
    src, cp, changes = (str(tmp_path / x) for x in ("src", "cp", "changes"))
    many = [(f"h{i}", "t", at(i), False) for i in range(40)]
    query = heartbeats(spark, src, cp, [many, [("h7", "t", at(100), True)]], changes=changes)
    assert query.lastProgress["stateOperators"][0]["numRowsUpdated"] == 1
    assert [r["host"] for r in spark.read.parquet(f"{changes}/batch=1").collect()] == ["h7"]
    before = seen(spark, cp)
    # The commit of the last batch is lost: it is run again, from the state before it.
    for name in ("1", ".1.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    heartbeats(spark, src, cp, [[("h8", "t", at(101), True)]], changes=changes)
    assert [r["host"] for r in spark.read.parquet(f"{changes}/batch=1").collect()] == ["h7"]
    assert set(seen(spark, cp)) - set(before) == {("t", at(101), True)} and len(seen(spark, cp)) == 40


def test_running_state_is_kept_without_a_python_call_for_each_key(spark, tmp_path):
    src, cp = (str(tmp_path / x) for x in ("src", "cp"))
    s = add(spark, src, [("h", at(1), float("nan"), "b"), ("h", at(2), None, None), ("h", at(1), 3.0, "c")], "host string, ts timestamp_ntz, share double, note string")
    stream = minutes.file_stream(spark, src, s)
    assert "TransformWithState" not in known.last_known(stream, ["host"], "ts", ["share", "note"])._jdf.queryExecution().analyzed().toString()
    known.run_last_known(stream, ["host"], "ts", ["share", "note"], cp)
    (row,) = known.known_now(spark, cp).collect()
    # NaN is a value that was given, and the largest.
    assert str(row["share"]) == "nan" and row["note"] == "c" and row["last_us"] - row["share_us"] == row["last_us"] - row["note_us"] == 1_000_000


def test_running_state_forgets_keys_that_stay_silent(spark, tmp_path):
    src, cp = (str(tmp_path / x) for x in ("src", "cp"))
    heartbeats(spark, src, cp, [[("h", "t", at(0), True), ("h", "u", at(90), True)], [("h", "u", at(200), False)]], forget_seconds=100)
    assert seen(spark, cp) == [("u", at(200), False)]


def test_dedup_within_the_wait(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in ([("a", at(0)), ("a", at(0)), ("b", at(60))], [("a", at(0)), ("c", at(61))]):
        s = add(spark, src, part, "k string, ts timestamp_ntz")
        minutes.run_to_folder(minutes.stream_dedup(minutes.file_stream(spark, src, s), "ts", ["k", "ts"], "1 hour"), out, cp)
    assert rows(spark.read.parquet(out), "k") == [("a",), ("b",), ("c",)]


def test_converge_stream_same_as_batch(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for part in ([("a", at(0)), ("a", at(100)), ("b", at(50))], [("a", at(299)), ("a", at(300)), ("a", at(301))], [("a", at(900)), ("b", at(349)), ("b", at(351))]):
        s = add(spark, src, part, "k string, ts timestamp_ntz")
        minutes.run_to_folder(keyed.stream_converge(minutes.file_stream(spark, src, s), ["k"], "ts", 300, "1 hour"), out, cp)
    got = rows(spark.read.parquet(out))
    assert got == rows(alarms.converge_exact(spark.read.parquet(src), ["k"], "ts", 300)) and len(got) == 5


def test_gap_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    us = lambda s: int((at(s) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    for part in ([("a", at(0)), ("b", at(0)), ("a", at(100))], [("a", at(500))], [("b", at(510)), ("a", at(510))], [("a", at(520))]):
        s = add(spark, src, part, "k string, ts timestamp_ntz")
        minutes.run_to_folder(keyed.stream_gap(minutes.file_stream(spark, src, s), ["k"], "ts", 300, "10 seconds"), out, cp)
    # b was told by the watermark after the second part and not again on its return; a by its own late report.
    assert sorted((r["k"], r["silent_since_us"]) for r in spark.read.parquet(out).collect()) == [("a", us(100)), ("b", us(0))]


def test_rate_alarm_with_late_and_repeated_samples(spark, tmp_path, rows):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "k string, slot timestamp_ntz, written timestamp_ntz, c long"
    sample = lambda m, c: ("a", at(60 * m), at(60 * m + 1), c)
    parts = [[sample(60, 100), sample(62, 9000)], [sample(61, 4000)], [sample(61, 4000), sample(62, 9000)], [sample(63, 9001)], [sample(1, 5), sample(2, 900_000)]]
    limits = lambda session: session.createDataFrame([("a", 10.0)], "k string, threshold double")
    each = minutes.alarm_batches(out, limits, keys=["k"], slot="slot", counter="c", threshold="threshold", step_seconds=60, alarm_id="110", end=F.col("slot"))
    for part in parts:
        s = add(spark, src, part, schema)
        minutes.run_batches(rates_of(minutes.file_stream(spark, src, s), late_seconds=300), each, cp)
    got = rows(spark.read.option("basePath", out).parquet(out), "k", "slot")
    # The pair of the late sample is found, nothing is told twice, and what is later than allowed is dropped.
    assert got == [("a", at(60 * 61)), ("a", at(60 * 62))]


def test_rate_stream_forgets_what_has_passed(spark, tmp_path):
    src, cp = (str(tmp_path / x) for x in ("src", "cp"))
    schema, found, held = "k string, slot timestamp_ntz, written timestamp_ntz, c long", [], []
    for part in range(3):
        s = add(spark, src, [(k, at(60 * m), at(60 * m + 1), 100 * m * m + 1) for k in ("a", "b", None) for m in range(100 * part, 100 * part + 100)], schema)
        rates = rates_of(minutes.file_stream(spark, src, s), late_seconds=120)
        query = minutes.run_batches(rates, lambda df, n: found.extend(df.select("k", "slot").collect()), cp)
        held.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    # Every sample but the first of each key has its rate, also across starts; what is held does not grow with what was seen.
    assert len(found) == len(set(found)) == 3 * 299
    assert max(held) <= held[0] and held[-1] < 100


def test_table_stream_takes_a_file_and_a_folder(spark, tmp_path):
    df = spark.range(100).repartition(5)
    folder, out, cp = (str(tmp_path / x) for x in ("t.parquet", "out", "cp"))
    df.write.parquet(folder)
    minutes.run_to_folder(minutes.table_stream(spark, folder, df.schema, 2), out, cp)
    assert spark.read.parquet(out).count() == 100
    (one,) = [p for p in (tmp_path / "t.parquet").glob("part-*") if spark.read.parquet(str(p)).count() == 20][:1]
    minutes.run_to_folder(minutes.table_stream(spark, str(one), df.schema), out + "1", cp + "1")
    assert spark.read.parquet(out + "1").count() == 20
