"""The skew-safe building blocks against plain Python, with one key that holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetloom.functions import skew


def fact_rows(n=400):
    rnd = random.Random(1)
    return [(i, rnd.choice([7] * 6 + [1, 2, 3, None])) for i in range(n)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("salted", [False, True])
def test_lookup_join_same_result_on_both_ways(spark, rows, how, salted):
    facts = spark.createDataFrame(fact_rows(), "id long, k long")
    dim = spark.createDataFrame([(7, "hot"), (1, "one"), (9, "nine")], "k long, v string")
    how_to = {"max_broadcast_rows": 0, "hot_min_rows": 0, "hot_share": 4, "salts": 8} if salted else {}
    got = skew.lookup_join(facts, dim, ["k"], how, spread=["id"], **how_to)
    assert rows(got, "id") == rows(facts.join(dim, ["k"], how), "id")
    if how in ("left", "inner"):
        assert rows(got, "id", "v") == rows(facts.join(dim, ["k"], how), "id", "v")


def test_salted_join_spreads_hot_key_and_null(spark):
    facts = spark.createDataFrame(fact_rows(), "id long, k long")
    hot = skew.hot_keys(facts, ["k"], share=4, min_rows=0)
    assert [r["k"] for r in hot.collect()] == [7]


def test_hot_keys_never_more_than_share(spark):
    facts = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert skew.hot_keys(facts, ["k"], share=5, min_rows=0).count() <= 5
    assert skew.hot_keys(facts, ["k"], share=5, min_rows=10_000).count() == 0


def series(n=300):
    rnd = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    picked = sorted(rnd.sample(range(20_000), n))
    return [("busy" if rnd.random() < 0.8 else "calm", start + dt.timedelta(minutes=m), m) for m in picked]


@pytest.mark.parametrize("slice_seconds", [3_600, 86_400, 10**8])
def test_previous_sample(spark, slice_seconds):
    data = series()
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v long")
    got = {(r["k"], r["v"]): r["prev_v"] for r in skew.previous_sample(df, ["k"], "ts", ["v"], slice_seconds).collect()}
    want, last = {}, {}
    for k, _, v in data:
        want[(k, v)] = last.get(k)
        last[k] = v
    assert got == want


@pytest.mark.parametrize("slice_seconds,hot_rows", [(60, 10**6), (60, 0), (7_200, 0), (10**8, 0)])
def test_ordinal_in_key(spark, slice_seconds, hot_rows):
    data = series() + [("busy", dt.datetime(2024, 1, 1), i) for i in (-3, -2, -1)] + [(None, dt.datetime(2024, 1, 2), -9), ("busy", None, -20)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v long")
    got = {(r["k"], r["v"]): r["ordinal"] for r in 
           skew.ordinal_in_key(df, ["k"], "ts", ["v"], slice_seconds, hot_share=3, hot_min_rows=hot_rows).collect()}
    want = {}
    for key in {d[0] for d in data}:
        mine = sorted((d for d in data if d[0] == key), key=lambda d: (d[1] or dt.datetime.min, d[2]))
        want.update({(key, d[2]): i + 1 for i, d in enumerate(mine)})
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 997])
def test_number_rows_is_gapless(spark, n):
    keys = [(i * 7919) % 10_007 for i in range(n)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = skew.number_rows(df, ["k"]).collect()
    assert sorted((r["row_no"], r["k"]) for r in got) == list(enumerate(sorted(keys), 1))


@pytest.mark.parametrize("n", [3, 1_000])
def test_top_n_per_group(spark, n):
    df = spark.range(5_000).select((F.col("id") % 2).alias("g"), "id")
    got = skew.top_n_per_group(df, ["g"], [F.desc("id")], n, ["id"])
    assert got.groupBy("g").count().filter(F.col("count") == n).count() == 2
    assert got.agg(F.min("id")).first()[0] == 5_000 - 2 * n


def test_broadcast_is_bounded_in_bytes(spark):
    wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("v"))
    assert skew.is_small(wide) and not skew.is_small(wide, max_bytes=5_000) and not skew.is_small(wide, max_rows=9)


def test_salts_follow_the_size_of_a_key(spark, rows):
    facts = spark.createDataFrame(fact_rows(), "id long, k long")
    dim = spark.createDataFrame([(7, "hot"), (1, "one")], "k long, v string")
    got = skew.lookup_join(facts, dim, ["k"], "left", spread=["id"], max_broadcast_rows=0, hot_min_rows=20, hot_share=4)
    assert rows(got, "id", "v") == rows(facts.join(dim, ["k"], "left"), "id", "v")
