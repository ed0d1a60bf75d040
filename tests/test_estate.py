"""Inventories, clusters, chains, shards, digests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import chains, digest, reconcile, shards
from fleetloom.operators import tables as op


def test_inventory(spark, rows):
    seg = "source string, name string, size long"
    expected = spark.createDataFrame([("a", "b.01", 10), ("a", "b.02", 20), ("a", "b.03", 30), ("a", "b.04", 40), ("c", "b.09", 1)], seg)
    held = spark.createDataFrame([("a", "b.01", 10), ("a", "b.02", 19), ("a", "b.04", 11), ("a", "x.01", 5)], seg)
    assert rows(reconcile.inventory_reconcile(expected, held, ["source"], "name", "size")) == [("a", "b.01", "Succ", 10), ("a", "b.02", "Fail", 0)]
    full = reconcile.inventory_reconcile(expected, held, ["source"], "name", "size", report_missing=True, report_unexpected=True)
    assert rows(full) == [("a", "b.01", "Succ", 10), ("a", "b.02", "Fail", 0), ("a", "b.03", "Missing", 0), ("a", "x.01", "Unexpected", 5)]
    assert rows(reconcile.drop_open_segment(expected, ["source"], "name"), "name") == [("b.01",), ("b.02",), ("b.03",)]
    assert rows(reconcile.first_segment(expected, ["source"], "name", ["size"])) == [("a", "b.01", 10), ("c", "b.09", 1)]


def instances(spark):
    return spark.createDataFrame([
        ("A", "m1", 1, "Master"), ("A", "s1", 1, "Slave"), ("A", "b1", 1, "Masterbackup"), ("B", "m2", 1, "Master"), ("B", "s2", 1, "Slave"),
    ], "type string, host string, port int, role string")


def test_peers_and_absent(spark, rows):
    masters = spark.createDataFrame([("m1", 1)], "host string, port int")
    assert rows(reconcile.peers_of(instances(spark), masters, "type", ["host", "port"], "role"), "host") == [("s1",)]
    inst = instances(spark).withColumn("state", F.lit("online"))
    active = spark.createDataFrame([("A",)], "type string")
    assert rows(reconcile.mark_absent(inst, active, "type", "state", ["host"]).filter("state = 'offline'"), "host") == [("m2",), ("s2",)]
    assert reconcile.mark_absent(inst, active.limit(0), "type", "state", ["host"]).filter("state = 'offline'").count() == 5


@pytest.mark.parametrize("waiting,role,lag,hit", [(0, "slave", 500, False), (9, "master", 500, False), (10, "master", 0, True), (1, "slave", 120, True), (1, "slave", 119, False)])
def test_protect_limits(spark, waiting, role, lag, hit):
    sessions = [("i", 0, "dump", "Sending data")] + [("i", n + 1, "app", "Waiting for table metadata lock") for n in range(waiting)]
    s = spark.createDataFrame(sessions, "instance string, id long, user string, state string")
    i = spark.createDataFrame([("i", role, lag)], "instance string, role string, lag int")
    got = reconcile.protect_candidates(s, i, "instance", F.col("user") == "dump", state="state", role="role", lag="lag", session_id="id")
    assert (got.count() == 1) is hit


def walk(spark, edges, **kw):
    df = spark.createDataFrame(edges, "child string, parent string, lag string")
    out = chains.walk_chain(df, "child", "parent", "lag", 3, **kw)
    return {r["node"]: (r["root"], r["depth"], r["path"], r["ended"]) for r in out.collect()}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_walk_chain(spark, broadcast):
    got = walk(spark, [("d", "c", "0"), ("c", "b", "2"), ("b", "a", "0"), ("x", "b", "3"), ("y", "x", "0"), ("z", "a", "NULL")], max_broadcast_rows=broadcast)
    assert got["a"] == ("a", 0, "a", "top") and got["d"] == ("a", 3, "d>c>b>a", "top")
    assert got["x"] == ("x", 0, "x", "lag") and got["y"] == ("x", 1, "y>x", "lag") and got["z"] == ("z", 0, "z", "lag")


def test_walk_chain_cycle_and_depth(spark):
    got = walk(spark, [("a", "b", "0"), ("b", "c", "0"), ("c", "a", "0"), ("t", "a", "0"), ("me", "me", "0")])
    assert {n: g[3] for n, g in got.items()} == dict.fromkeys(["a", "b", "c", "t", "me"], "cycle")
    assert got["t"][0] is None
    long = walk(spark, [(str(i), str(i + 1), "0") for i in range(130)])
    assert long["0"][:2] == ("130", 130)
    with pytest.raises(Exception, match="more than one source"):
        walk(spark, [("a", "b", "0"), ("a", "c", "0")])


def test_walk_chain_of_some_thousand_hops_and_asked_paths(spark):
    n = 3000
    rows = [(str(i), str(i + 1), "0") for i in range(n)] + [(f"c{i}", f"c{(i + 1) % 700}", "0") for i in range(700)] + [("below", "c5", "0"), ("off", "4", "7")]
    df = spark.createDataFrame(rows, "child string, parent string, lag string")
    asked = spark.createDataFrame([("2990",), ("3000",), ("c1",), ("off",), ("nobody",), ("2990",), (None,)], "which string")
    got = {r["node"]: (r["root"], r["depth"], r["path"], r["ended"]) for r in chains.walk_chain(df, "child", "parent", "lag", 3, paths=asked).collect()}
    assert len(got) == n + 1 + 702
    assert all(got[str(i)] == ("3000", n - i, None, "top") for i in range(n) if i != 2990)
    assert got["2990"] == ("3000", 10, ">".join(str(i) for i in range(2990, 3001)), "top") and got["3000"][2] == "3000"
    assert {got[x] for x in ("c0", "c699", "below", "c1")} == {(None, None, None, "cycle")} and got["off"] == ("off", 0, "off", "lag")
    none = chains.walk_chain(df, "child", "parent", "lag", 3, paths=False)
    assert none.filter("path IS NOT NULL").count() == 0 and none.count() == len(got)


def test_walk_chain_too_large_to_broadcast_goes_by_marked_nodes(spark, monkeypatch):
    n, walks = 1500, []
    walk_table = chains._walk
    monkeypatch.setattr(chains, "_walk", lambda table, *rest: walks.append(table.count()) or walk_table(table, *rest))
    rows = [(i, i + 1, 0) for i in range(n)] + [(n + 1 + i, i * 7, 0) for i in range(60)] + [(5000 + i, 5000 + (i + 1) % 90, 0) for i in range(90)] + [(6000, 5003, 0), (6001, 4, 7)]
    df = spark.createDataFrame(rows, "child long, parent long, lag int")
    asked = spark.createDataFrame([(3,), (n + 9,), (5001,), (n,), (6001,)], "which long")
    got = {r["node"]: (r["root"], r["depth"], r["path"], r["ended"]) for r in chains.walk_chain(df, "child", "parent", "lag", 3, 0, paths=asked).collect()}
    up = lambda i: ">".join(map(str, range(i, n + 1)))
    want = {i: (n, n - i, up(i) if i in (3, n) else None, "top") for i in range(n + 1)}
    want |= {n + 1 + i: (n, n + 1 - 7 * i, f"{n + 9}>{up(56)}" if i == 8 else None, "top") for i in range(60)}
    want |= {i: (None, None, None, "cycle") for i in [*range(5000, 5090), 6000]} | {6001: (6001, 0, "6001", "lag")}
    assert got == want
    # A sixteenth of the nodes goes through all rounds.
    assert len(walks) == 2 and walks[1] < walks[0] / 8


def test_promote_grandparent(spark, rows):
    df = spark.createDataFrame([("d", "c", 0), ("c", "b", 2), ("b", "a", 3), ("e", "d", 0)], "child string, parent string, lag int")
    for broadcast in (100_000, 0):
        assert rows(chains.promote_grandparent(df, "child", "parent", "lag", 3, broadcast)) == [("c", "d", "b"), ("d", "e", "c")]


def test_shards(spark, rows):
    day = shards.shard_calendar(spark, "x_#yyyy#_db.t_#mmdd#", dt.date(2023, 12, 31), dt.date(2024, 1, 1))
    assert rows(day) == [("x_2023_db.t_1231",), ("x_2024_db.t_0101",)]
    month = shards.shard_calendar(spark, "x_#yyyy#_db.t_#mm#", dt.date(2023, 11, 30), dt.date(2024, 1, 1))
    assert rows(month) == [("x_2023_db.t_11",), ("x_2023_db.t_12",), ("x_2024_db.t_01",)]
    assert shards.default_end(dt.date(2024, 5, 1)) == dt.date(2025, 12, 31)
    present = spark.createDataFrame([("x_2023_db.t_11",), ("x_2022_db.t_01",)], "shard string")
    assert rows(shards.shard_coverage(month, present)) == [
        ("x_2022_db.t_01", "extra"), ("x_2023_db.t_12", "absent"), ("x_2024_db.t_01", "absent")]
    names = spark.createDataFrame([("x_2023_db.t_1231",), ("x_2023_db.t_12",), ("x_2023_dbxt_1231",), ("ax_2023_db.t_1231",)], "n string")
    assert rows(op.shard_match(names, "n", "x_#yyyy#_db.t_#mmdd#")) == [("x_2023_db.t_1231",)]


def test_shard_union_from_files(spark, tmp_path, rows):
    spark.createDataFrame([(1, "a")], "id long, c string").write.parquet(str(tmp_path / "s1"))
    spark.createDataFrame([(2,)], "id long").write.parquet(str(tmp_path / "s2"))
    both = shards.shard_union_paths(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")])
    assert rows(both, "id", "c") == [(1, "a"), (2, None)]
    assert rows(shards.shard_union([spark.read.parquet(str(tmp_path / p)) for p in ("s1", "s2")]), "id", "c") == [(1, "a"), (2, None)]


def test_history_merges_to_days_and_to_all_time(spark):
    import random

    rng = random.Random(4)
    data = [(f"select {i}", 60 * i, rng.expovariate(1 / 50), rng.randrange(1500), "s%d" % (i % 2)) for i in range(20_000)]
    data += [("rare 1", 5, None, None, "s0"), ("rare 2", 90_000, 7.0, 3, "s1"), ("", 5, 1.0, 1, "s0"), (None, 5, 1.0, 1, "s0")]
    df = spark.createDataFrame(data, "text string, at long, metric double, who long, source string").withColumn("ts", F.timestamp_seconds("at"))
    hourly = digest.digest_history(df, "text", "ts", "metric", ["source"], 3_600, "who")
    daily = digest.digest_merge(hourly, [], 86_400)
    found = {(r["fingerprint"], r["slot_epoch"] // 86_400): r for r in digest.digest_read(daily).collect()}
    for day in range(14):
        mine = [d for d in data[:20_000] if d[1] // 86_400 == day]
        r = found["select ?", day]
        assert (r["calls"], r["metric_min"], r["metric_max"]) == (len(mine), min(d[2] for d in mine), max(d[2] for d in mine))
        assert abs(sum(d[2] <= r["metric_pct"] for d in mine) / len(mine) - 0.95) < 0.01
        users = len({d[3] for d in mine})
        assert abs(r["who_count"] - users) <= 0.08 * users
    assert len(found) == 16 and found["rare ?", 0]["metric_pct"] is None and found["rare ?", 0]["who_count"] == 0
    # Hours to days to all time is hours to all time; the distribution of all is still right.
    for all_time in (digest.digest_merge(daily, []), digest.digest_merge(hourly, [])):
        (r,) = digest.digest_read(all_time, 0.5).filter("fingerprint = 'select ?'").collect()
        assert r["calls"] == 20_000 and abs(sum(d[2] <= r["metric_pct"] for d in data[:20_000]) / 20_000 - 0.5) < 0.01
    assert digest.digest_read(digest.digest_merge(digest.digest_history(df.limit(0), "text", "ts", "metric", [], 60), [], 86_400)).collect() == []


def test_digest(spark, rows):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame([
        ("db", at(0), "SELECT  * FROM t WHERE id = 12", 1.0), ("db", at(5), "select * from t\nwhere id = 7", 3.0), ("db", at(9), "select 'x1', 2", 1.0), ("db", at(9), "", 9.0),
    ], "source string, ts timestamp_ntz, text string, metric double")
    h = digest.digest_rollup(df, "text", "ts", "metric", ["source"], 60)
    assert rows(h, "fingerprint", "calls", "metric_sum", "metric_min", "metric_max") == [
        ("select * from t where id = ?", 2, 4.0, 1.0, 3.0), ("select ?, ?", 1, 1.0, 1.0, 1.0)]
    old = spark.createDataFrame([("select ?, ?", 1, 2)], "fingerprint string, first_seen long, last_seen long")
    merged = {r["fingerprint"]: (r["first_seen"], r["last_seen"] > 2) for r in digest.digest_review(h, old).collect()}
    assert merged["select ?, ?"] == (1, True) and len(merged) == 2


def test_periodic_capture(spark, rows):
    df = spark.range(40).select(F.lit("s").alias("source"), F.timestamp_seconds("id").alias("ts"), "id")
    got = digest.periodic_capture(df, ["source"], "ts", ["id"], 3, 7, 2)
    assert rows(got, "id") == sorted([(c * 10 + i,) for c in range(4) for i in range(2)], key=repr)


def test_names_and_windows(spark, rows):
    names = spark.createDataFrame([("log_2019010107",), ("log_2019022007",), ("log_2019010107_x",), ("log_2019130107",), ("xlog_2019010107",)], "n string")
    assert rows(op.name_age_filter(names, "n", "log", dt.date(2019, 2, 27), 7), "n") == [("log_2019010107",), ("log_2019010107_x",)]
    t = spark.createDataFrame([(s, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for s in (10, 11, 20)], "s int, ts timestamp_ntz")
    assert rows(op.in_daily_window(t, "ts", 10, 20), "s") == [(11,)]
    assert rows(op.in_daily_window(t, "ts", 10, 20, "right"), "s") == [(11,), (20,)]
    assert rows(op.in_daily_window(t, "ts", 10, 20, "both"), "s") == [(10,), (11,), (20,)]


@pytest.mark.parametrize("setting,day,due", [(9, "2024-01-07", True), (0, "2024-01-07", True), (1, "2024-01-07", False), (1, "2024-01-09", True), (6, "2024-01-12", False), (8, "2024-01-09", False), (7, "2024-01-13", False)])
def test_weekday_due(spark, setting, day, due):
    assert spark.range(1).select(op.weekday_due(F.lit(day).cast("date"), F.lit(setting))).first()[0] is due


def test_small_operators(spark, rows):
    df = spark.createDataFrame([("a", "10", "x"), ("b", "ten", None)], "k string, n string, c string")
    from pyspark.sql import types as T
    assert rows(op.typed_cast(df, T.StructType.fromDDL("k string, n int"))) == [("a", 10), ("b", None)]
    assert rows(op.null_defaults(df, {"c": "0"}), "c") == [("0",), ("x",)]
    assert rows(op.exclude_names(df, "k", ["a"])) == [("b", "ten", None)]
    assert rows(op.unpivot_metrics(spark.createDataFrame([("h", 1, 2.5)], "h string, a long, b double"), ["h"], ["a", "b"])) == [("h", "a", 1.0), ("h", "b", 2.5)]
    keep = df.limit(0).select("k")
    assert op.minus_keep(df, keep, ["k"]).count() == 2
    assert rows(op.keep_union(df.select("k"), df.select("k"))) == [("a",), ("b",)]
    assert [r["k"] for r in op.nth_row(df, ["k"], 2).collect()] == ["b"]
    lim = spark.createDataFrame([(1, 10), (2, 11)], "id int, v int")
    assert rows(op.threshold_breach(lim, "v", 10), "id") == [(2,)] and op.threshold_breach(lim, "v", 10, inclusive=True).count() == 2
    role = spark.createDataFrame([(None, None, None), ("Yes", "Yes", "7"), ("Yes", "No", "7"), ("Yes", "Yes", "NULL")], "io string, sql string, behind string")
    assert rows(op.role_and_lag(role, "io", "sql", "behind"), "role", "lag") == sorted([("master", 0), ("slave", 7), ("master", 0), ("slave", None)], key=repr)


def test_estate_sync(spark, rows):
    from fleetloom.plans.estate_sync import sync_backup_info

    inst = spark.createDataFrame([
        ("A", "m", 1, "Master", "online"), ("A", "s", 1, "Slave", "online"), ("A", "b", 1, "Masterbackup", "online"),
        ("B", "m", 1, "Master", "online"), ("B", "s", 1, "Slave", "offline"), ("C", "m", 1, "Master", "online"), ("C", "s", 2, "Slave", "online"),
        ("D", "m", 1, "Master", "offline"), ("D", "s", 1, "Slave", "online"),
    ], "type string, server_host string, server_port int, role string, state string")
    info = spark.createDataFrame([("A", "old", "x", 9, "paused", 3), ("B", "old", "x", 9, "online", 3), ("D", "old", "x", 9, "online", 3)],
                                 "type string, address string, source_host string, source_port int, state string, weekday int")
    assert rows(sync_backup_info(info, inst, "net", {"state": "online", "weekday": 9})) == [
        ("A", "net", "b", 1, "paused", 3), ("B", "old", "x", 9, "offline", 3), ("C", "net", "s", 2, "online", 9), ("D", "old", "x", 9, "offline", 3)]


@pytest.mark.parametrize("text,want", [
    ("SELECT 12, 'a1b' FROM t7", "select ?, ? from t?"), ("it's 5 o'clock", "it?clock"), ("don't 12", "don't ?"), ("''", "?"), ("'1'2'3'", "???"),
    ("  a \t\n b  ", "a b"), ("", ""), ("007", "?"),
])
def test_fingerprint(spark, text, want):
    assert spark.range(1).select(digest.fingerprint(F.lit(text))).first()[0] == want
