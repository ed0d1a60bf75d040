"""Scans, projections, filters, order and limit."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.catalogue.registry import query, table
from fleetloom.functions.skew import top_n_per_group
from fleetloom.operators import tables as op
from fleetloom.sources.tables import scan_table


@query("scan_table", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45")
def scan(spark, d):
    return scan_table(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_extendedprice"], F.col("l_quantity") > 45)


@query("null_defaults", """
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '0') AS o_orderstatus, coalesce(nullif(o_orderpriority, '5-LOW'), '') AS o_orderpriority
FROM orders
""")
def null_defaults(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")
    )
    return op.null_defaults(o, {"o_orderstatus": "0", "o_orderpriority": ""})


@query("typed_cast", """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer
""")
def typed_cast(spark, d):
    raw = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.col("c_nationkey").cast("string"),
    )
    return op.typed_cast(raw, T.StructType.fromDDL("c_custkey long, c_acctbal double, c_nationkey long"))


@query("active_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def active_rows(spark, d):
    return op.active_rows(table(spark, d, "orders"), "o_orderstatus", "O").select("o_orderkey")


@query("exclude_names", """
SELECT p_partkey, p_name FROM part WHERE p_name NOT IN ('red plate', 'hot ring') AND NOT regexp_matches(p_name, '^(small|large) ')
""")
def exclude_names(spark, d):
    out = op.exclude_names(table(spark, d, "part"), "p_name", ["red plate", "hot ring"], "^(small|large) ")
    return out.select("p_partkey", "p_name")


@query("like_filter", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%l% plate'")
def like_filter(spark, d):
    return op.like_filter(table(spark, d, "part"), "p_name", "%l% plate").select("p_partkey", "p_name")


SECOND = "(epoch_us(ts) // 1000000 % 86400)"


@query("in_daily_window", f"SELECT event_id FROM events WHERE {SECOND} > 1 AND {SECOND} < 3601")
def in_daily_window(spark, d):
    return op.in_daily_window(table(spark, d, "events"), "ts", 1, 3601).select("event_id")


@query("in_daily_window_right", f"SELECT event_id FROM events WHERE {SECOND} > 3600 AND {SECOND} <= 7200")
def in_daily_window_right(spark, d):
    return op.in_daily_window(table(spark, d, "events"), "ts", 3600, 7200, closed="right").select("event_id")


@query("weekday_due", """
SELECT event_id, CASE WHEN user_id % 11 = 9 THEN true WHEN user_id % 11 <= 6 THEN user_id % 11 <= dayofweek(ts) ELSE false END AS due FROM events
""")
def weekday_due(spark, d):
    return table(spark, d, "events").select("event_id", op.weekday_due(F.to_date("ts"), F.col("user_id") % 11).alias("due"))


@query("derive_and_require", """
SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS bytes, 'host-1' AS hostname FROM conversations WHERE length(text) > 0
""")
def derive_and_require(spark, d):
    out = op.derive_and_require(
        table(spark, d, "conversations"), {"bytes": "cast(octet_length(text) as bigint)", "hostname": "'host-1'"}, F.col("text")
    )
    return out.select("conv_id", "turn", "bytes", "hostname")


@query("first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def first_n(spark, d):
    return op.first_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 20)


@query("last_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def last_n(spark, d):
    return op.last_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 20)


@query("nth_row", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2 OFFSET 999")
def nth_row(spark, d):
    return op.nth_row(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 1000)


@query("top_n_per_group", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events)
SELECT user_id, event_id FROM r WHERE rn <= 5
""")
def top_n(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "value")
    return top_n_per_group(ev, ["user_id"], [F.desc("value"), F.asc("event_id")], 5, ["event_id"]).select("user_id", "event_id")


@query("top_n_per_group_large", """
WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events)
SELECT event_type, event_id FROM r WHERE rn <= 1500
""")
def top_n_large(spark, d):
    ev = table(spark, d, "events").select("event_type", "event_id", "value")
    return top_n_per_group(ev, ["event_type"], [F.desc("value"), F.asc("event_id")], 1500, ["event_id"]).select("event_type", "event_id")
