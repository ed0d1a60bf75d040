import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetloom.operators import alarms

START = dt.datetime(2024, 1, 1)


def loop(times, hold):
    """Send if none was sent in the last ``hold``, one alarm after the other."""
    sent = []
    for t in sorted(set(times)):
        if not sent or t - sent[-1] >= hold:
            sent.append(t)
    return sent


def stretches(times, hold, length):
    """Alarms by slice, and the summary of every slice."""
    parts = {}
    for t in sorted(set(times)):
        parts.setdefault(t // length, []).append(t)
    found = []
    for n, part in parts.items():
        starts, ends = alarms.slice_exits(np.array(part), n * length, hold)
        found.append({"_slice": n, "_first": n, "_t": starts, "_e": ends + hold})
    return parts, found


def joined(parts, hold, length):
    first, t, e = alarms.joined_steps(parts, hold, length)
    return {"_slice": first, "_first": first, "_t": t, "_e": e}


@given(st.lists(st.integers(0, 2_000), max_size=80), st.integers(1, 200), st.integers(0, 300), st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_slices_compose_to_the_loop(times, hold, more, rnd):
    """Joined in any nesting, the slices before one give the state the loop would enter it with."""
    length = hold + more
    parts, summaries = stretches(times, hold, length)
    got = []
    for i, n in enumerate(parts):
        before, allowed = summaries[:i], alarms.NEVER
        while len(before) > 1:
            at = rnd.randrange(len(before) - 1)
            before[at : at + 2] = [joined(before[at : at + 2], hold, length)]
        for p in before:
            assert len(p["_t"]) <= len(summaries[0]["_t"]) + 1
            allowed = int(alarms.allowed_after(p["_t"], p["_e"], allowed))
        got += alarms.sent_times(np.array(parts[n]), hold, allowed).tolist()
    assert got == loop(times, hold)


def frame(spark, n=600):
    rnd = np.random.default_rng(3)
    data = [("busy", START + dt.timedelta(seconds=int(s)), i) for i, s in enumerate(rnd.integers(0, 40_000, n))]
    data += [("calm", START + dt.timedelta(hours=h), n + h) for h in range(5)] + [(None, START, 9_999), (None, START + dt.timedelta(days=1), 9_998), ("busy", START, 10_000)]
    return data, spark.createDataFrame(data, "k string, ts timestamp_ntz, id long")


def test_converge_exact_matches_the_loop(spark):
    data, df = frame(spark)
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    for slice_seconds, hot_rows, fan in ((0, 10**6, 64), (0, 0, 3), (900, 0, 64), (10**6, 0, 64)):
        out = alarms.converge_exact(df, ["k"], "ts", 300, slice_seconds, hot_share=3, hot_min_rows=hot_rows, fan=fan)
        got = sorted(((r["k"], r["sent_us"]) for r in out.collect()), key=repr)
        want = [(k, t) for k in {d[0] for d in data} for t in loop([us(d[1]) for d in data if d[0] == k], 300_000_000)]
        assert got == sorted(want, key=repr)


def test_no_group_holds_more_slices_than_the_fan(spark, monkeypatch):
    """One key with hundreds of slices: what is joined or walked in one group is counted."""
    called, over = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real = alarms.joined_steps

    def watched(parts, hold, length):
        called.add(1)
        over.add(int(len(parts) > 8))
        return real(parts, hold, length)

    monkeypatch.setattr(alarms, "joined_steps", watched)
    data = [("k", START + dt.timedelta(seconds=7 * i + i % 5), i) for i in range(3000)]
    out = alarms.converge_exact(spark.createDataFrame(data, "k string, ts timestamp_ntz, id long"), ["k"], "ts", 50, 50, hot_share=3, hot_min_rows=0, fan=8)
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert sorted(r["sent_us"] for r in out.collect()) == loop([us(d[1]) for d in data], 50_000_000)
    assert called.value > 50 and over.value == 0


def test_converge_count(spark):
    data, df = frame(spark)
    got = {(r["k"], r["id"]) for r in alarms.converge_count(df, ["k"], "ts", ["id"], 10).collect()}
    want = set()
    for key in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]))
        want |= {(key, d[2]) for d in mine[::10]}
    assert got == want


def test_converge_time(spark, rows):
    at = lambda s: START + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", at(0), 2), ("a", at(0), 1), ("a", at(59), 3), ("a", at(60), 4)], "k string, ts timestamp_ntz, id long")
    got = rows(alarms.converge_time(df, ["k"], "ts", ["id"], 60), "k", "ts", "id", "alarms")
    assert got == [("a", at(0), 1, 3), ("a", at(60), 4, 1)]


def test_summary_of_a_slice_is_small():
    times = np.arange(0, 20_000 * 10, 10)
    starts, ends = alarms.slice_exits(times, 0, 20_000)
    assert len(starts) == len(ends) < len(times) / 9
