import datetime as dt

from pyspark.sql import functions as F

from fleetloom.operators import gaps

ZERO = dt.datetime(2024, 1, 1)
BASE = int((ZERO - dt.datetime(1970, 1, 1)).total_seconds())


def at(minute):
    return ZERO + dt.timedelta(minutes=minute)


def sec(minute):
    return BASE + 60 * minute


def samples(spark):
    return spark.createDataFrame(
        [("a", at(0), 1), ("a", at(1), 2), ("a", at(4), 5), ("a", at(4), 5), ("b", at(2), 7), ("c", at(0), 1), ("c", at(3000), 9)],
        "k string, slot timestamp_ntz, v long")


def test_islands_and_markers(spark, rows):
    assert rows(gaps.gap_islands(samples(spark), ["k"], "slot", 60)) == [("a", sec(2), sec(3), 2), ("c", sec(1), sec(2999), 2999)]
    assert rows(gaps.gap_islands(samples(spark), ["k"], "slot", 60, min_slots=3)) == [("c", sec(1), sec(2999), 2999)]
    markers = gaps.gap_markers(samples(spark), ["k"], "slot", 60)
    assert rows(markers.filter("k = 'a'")) == [("a", sec(2)), ("a", sec(3))]
    assert markers.filter("k = 'c'").count() == 2999 == markers.filter("k = 'c'").distinct().count()


def test_bounded_range(spark, rows):
    got = gaps.gap_islands(samples(spark).filter("k in ('a', 'b')"), ["k"], "slot", 60, bounds=(sec(0), sec(5)))
    assert rows(got) == [("a", sec(2), sec(3), 2), ("a", sec(5), sec(5), 1), ("b", sec(0), sec(1), 2), ("b", sec(3), sec(5), 3)]


def test_fill_gaps(spark, rows):
    df = samples(spark).distinct().unionByName(spark.createDataFrame([("a", at(3), None)], "k string, slot timestamp_ntz, v long"))
    got = gaps.fill_gaps(df, ["k"], "slot", ["v"], 60)
    assert rows(got.filter("k = 'a'")) == [
        ("a", sec(0), 1, False), ("a", sec(1), 2, False), ("a", sec(2), 2, True), ("a", sec(3), 2, True), ("a", sec(4), 5, False)]
    assert rows(got.filter("k = 'b'")) == [("b", sec(2), 7, False)]
    assert got.filter("k = 'c'").count() == 3001


def test_expected_keys_that_never_reported(spark, rows):
    want = spark.createDataFrame([("a",), ("z",)], "k string")
    got = gaps.gap_islands(samples(spark).filter("k = 'a'"), ["k"], "slot", 60, bounds=(sec(0), sec(5)), expected=want)
    assert rows(got) == [("a", sec(2), sec(3), 2), ("a", sec(5), sec(5), 1), ("z", sec(0), sec(5), 6)]
    late = gaps.overdue(samples(spark), ["k"], "slot", F.lit(at(5)), 3600, expected=want)
    assert rows(late, "k", "last_seen", "late_seconds") == [("z", None, None)]


def test_fill_each_value_on_its_own(spark, rows):
    df = spark.createDataFrame([
        ("a", at(0), None, 1), ("a", at(1), 5, None), ("a", at(3), None, 4), ("a", at(2000), None, None), ("a", at(2001), 9, 9),
    ], "k string, slot timestamp_ntz, x long, y long")
    got = {r["slot_epoch"]: (r["x"], r["y"], r["filled"]) for r in gaps.fill_gaps(df, ["k"], "slot", ["x", "y"], 60).collect()}
    assert len(got) == 2002
    assert [got[sec(m)] for m in (0, 1, 2, 3, 4, 1999, 2000, 2001)] == [
        (None, 1, True), (5, 1, True), (5, 1, True), (5, 4, True), (5, 4, True), (5, 4, True), (5, 4, True), (9, 9, False)]


def test_overdue_at_the_limit(spark, rows):
    got = gaps.overdue(samples(spark), ["k"], "slot", F.lit(at(64)), 3600)
    assert rows(got, "k", "late_seconds") == [("a", 3600), ("b", 3720)]


def test_capacity_trend(spark, rows):
    day = lambda d: dt.date(2024, 1, d)
    df = spark.createDataFrame([("t", day(1), 9), ("t", day(2), 10), ("t", day(2), 5), ("t", day(4), 30)], "t string, d date, n long")
    assert rows(gaps.capacity_trend(df, ["t"], "d", ["n"], F.lit(day(4)), 3)) == [("t", day(2), 15, None), ("t", day(4), 30, 15)]


def test_gaps_are_cut_to_the_bounds(spark, rows):
    def found(times, bounds):
        df = spark.createDataFrame([("a", dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t)) for t in times], "k string, ts timestamp_ntz")
        return rows(gaps.gap_islands(df, ["k"], "ts", 100, bounds=bounds), "gap_start", "gap_end", "missing")

    assert found([0, 600], (200, 500)) == [(200, 500, 4)]
    assert found([2000], (200, 500)) == [(200, 500, 4)]
    assert found([300, 900], (200, 500)) == [(200, 200, 1), (400, 500, 2)]
    assert found([-500, 300], (200, 500)) == [(200, 200, 1), (400, 500, 2)]
