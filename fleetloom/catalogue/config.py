"""Layered configuration over customers, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetloom.catalogue.registry import query, table
from fleetloom.operators import config

TIERS = """
person AS (SELECT c_custkey, CASE WHEN c_custkey % 14 = 0 THEN '' ELSE 'p' || CAST(c_custkey AS VARCHAR) END AS v FROM customer
           WHERE c_custkey % 7 = 0 AND c_acctbal > 0),
common AS (SELECT n_nationkey, n_name AS v FROM nation WHERE n_nationkey % 5 <> 0),
local AS (SELECT n_nationkey, 'file' AS v FROM nation WHERE n_nationkey % 10 = 0)
"""


def tiers(spark, d):
    cust = table(spark, d, "customer")
    nation = table(spark, d, "nation")
    state = lambda on: F.when(on, "online").otherwise("offline").alias("state")
    asked = cust.select(F.col("c_nationkey").alias("key"), "c_custkey")
    person = cust.filter(F.col("c_custkey") % 7 == 0).select(
        F.col("c_nationkey").alias("key"), "c_custkey",
        F.when(F.col("c_custkey") % 14 == 0, "").otherwise(F.concat(F.lit("p"), F.col("c_custkey").cast("string"))).alias("value"),
        state(F.col("c_acctbal") > 0),
    )
    common = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"), state(F.col("n_nationkey") % 5 != 0))
    local = nation.filter(F.col("n_nationkey") % 10 == 0).select(F.col("n_nationkey").alias("key"), F.lit("file").alias("value"))
    return asked, person, common, local


@query("resolve_config", f"""
WITH {TIERS}
SELECT c.c_custkey, CAST(c.c_nationkey AS BIGINT) AS key, coalesce(nullif(p.v, ''), m.v, l.v) AS value,
       CASE WHEN nullif(p.v, '') IS NOT NULL THEN 'person' WHEN m.v IS NOT NULL THEN 'common' WHEN l.v IS NOT NULL THEN 'local'
            ELSE 'none' END AS source, coalesce(nullif(p.v, ''), m.v, l.v) IS NULL AS missing
FROM customer c LEFT JOIN person p ON p.c_custkey = c.c_custkey LEFT JOIN common m ON m.n_nationkey = c.c_nationkey
LEFT JOIN local l ON l.n_nationkey = c.c_nationkey
""")
def resolve_config(spark, d):
    asked, person, common, local = tiers(spark, d)
    out = config.resolve_config(asked, person, common, local, person_keys=["key", "c_custkey"])
    return out.withColumn("key", F.col("key").cast("long"))


@query("config_map", """
SELECT CAST(n_regionkey AS BIGINT) AS region, string_agg(n_name || '=' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name) AS conf
FROM nation GROUP BY 1
""")
def config_map(spark, d):
    rows = table(spark, d, "nation").select(
        F.col("n_regionkey").cast("long").alias("region"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value")
    )
    pairs = F.transform(F.array_sort(F.map_entries("conf")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return config.config_map(rows, ["region"]).select("region", F.array_join(pairs, ",").alias("conf"))


@query("resolve_script_state", """
WITH h AS (SELECT s_suppkey FROM supplier), c AS (SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 3 <> 0),
p AS (SELECT s_suppkey, 'NATION_' || CAST(s_nationkey AS VARCHAR) AS n_name FROM supplier WHERE s_acctbal > 5000)
SELECT h.s_suppkey, c.n_name AS basename, CASE WHEN p.n_name IS NOT NULL THEN 'off' ELSE 'on' || CAST(c.n_regionkey AS VARCHAR) END
       AS running_state, CASE WHEN p.n_name IS NOT NULL THEN 'person' ELSE 'common' END AS source
FROM h CROSS JOIN c LEFT JOIN p ON p.s_suppkey = h.s_suppkey AND p.n_name = c.n_name
""")
def resolve_script_state(spark, d):
    supp = table(spark, d, "supplier")
    online = F.lit("online").alias("state")
    each_minute = F.lit("1 MINUTE").alias("frequency")
    common = table(spark, d, "nation").select(
        F.col("n_name").alias("basename"), each_minute, F.concat(F.lit("on"), F.col("n_regionkey").cast("string")).alias("running_state"),
        F.when(F.col("n_nationkey") % 3 != 0, "online").otherwise("offline").alias("state"),
    )
    person = supp.filter(F.col("s_acctbal") > 5000).select(
        "s_suppkey", F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("basename"), each_minute,
        F.lit("off").alias("running_state"), online,
    )
    return config.resolve_script_state(supp, common, person, "1 MINUTE", host="s_suppkey")


@query("keys_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def keys_filter(spark, d):
    from fleetloom.operators.tables import keys_filter as op

    return op(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("keys_filter_table", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def keys_filter_table(spark, d):
    from fleetloom.operators.tables import keys_filter as op

    wanted = table(spark, d, "customer").filter(F.col("c_acctbal") < 0).select("c_custkey")
    return op(table(spark, d, "orders"), "o_custkey", wanted, ["o_orderkey"]).select("o_orderkey")
