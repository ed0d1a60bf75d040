"""Segments, clusters, chains, shards."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetloom.catalogue.registry import query, table
from fleetloom.functions.skew import number_rows
from fleetloom.operators import chains, reconcile, shards
from fleetloom.plans.estate_sync import sync_backup_info
from fleetloom.operators.tables import name_age_filter, positions_equal, project_catalogue, role_and_lag, shard_match

SEGMENTS = """
e AS (SELECT l_orderkey % 500 AS source, l_orderkey AS name, count(*) AS size FROM lineitem GROUP BY 1, 2),
h AS (SELECT source, CASE WHEN name % 13 = 0 THEN name + 100000000 ELSE name END AS name, CASE WHEN name % 7 = 0 THEN size + 1 ELSE size END AS size
      FROM e WHERE name % 5 <> 0),
due AS (SELECT source, name, size FROM e WHERE name < (SELECT max(x.name) FROM e x WHERE x.source = e.source))
"""


def segments(spark, d):
    exp = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("source"), F.col("l_orderkey").alias("name")).agg(
        F.count("*").alias("size")
    )
    held = exp.filter(F.col("name") % 5 != 0).select(
        "source", F.when(F.col("name") % 13 == 0, F.col("name") + 100_000_000).otherwise(F.col("name")).alias("name"),
        F.when(F.col("name") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
    )
    return exp, held


@query("inventory_reconcile", f"""
WITH {SEGMENTS}
SELECT due.source, due.name, CASE WHEN due.size = h.size THEN 'Succ' ELSE 'Fail' END AS status,
       CASE WHEN due.size = h.size THEN h.size ELSE 0 END AS size FROM due JOIN h ON due.source = h.source AND due.name = h.name
""")
def inventory_reconcile(spark, d):
    exp, held = segments(spark, d)
    return reconcile.inventory_reconcile(exp, held, ["source"], "name", "size")


@query("inventory_reconcile_full", f"""
WITH {SEGMENTS}
SELECT coalesce(due.source, h.source) AS source, coalesce(due.name, h.name) AS name,
       CASE WHEN h.size IS NULL THEN 'Missing' WHEN due.size IS NULL THEN 'Unexpected' WHEN due.size = h.size THEN 'Succ' ELSE 'Fail' END AS status,
       CASE WHEN h.size IS NOT NULL AND (due.size IS NULL OR due.size = h.size) THEN h.size ELSE 0 END AS size
FROM due FULL JOIN h ON due.source = h.source AND due.name = h.name
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = h.source AND e.name = h.name AND due.name IS NULL)
""")
def inventory_full(spark, d):
    exp, held = segments(spark, d)
    return reconcile.inventory_reconcile(exp, held, ["source"], "name", "size", report_missing=True, report_unexpected=True)


@query("drop_open_segment", """
SELECT user_id, event_id FROM events e WHERE event_id < (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)
""")
def drop_open_segment(spark, d):
    return reconcile.drop_open_segment(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("first_segment", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def first_segment(spark, d):
    return reconcile.first_segment(table(spark, d, "events"), ["user_id"], "event_id", ["event_type"])


ROLES = """
i AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN 'Master' WHEN c_custkey % 10 < 7 THEN 'Slave' ELSE 'Masterbackup' END AS role
      FROM customer)
"""


def roles(spark, d):
    role = F.when(F.col("c_custkey") % 10 == 0, "Master").when(F.col("c_custkey") % 10 < 7, "Slave").otherwise("Masterbackup")
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", role.alias("role"), "c_acctbal")


@query("peers_of", f"""
WITH {ROLES}
SELECT c_custkey FROM i WHERE role = 'Slave' AND c_nationkey IN
  (SELECT c.c_nationkey FROM customer c WHERE c_custkey % 10 = 0 AND c_acctbal > 8000)
""")
def peers_of(spark, d):
    inst = roles(spark, d)
    masters = inst.filter((F.col("role") == "Master") & (F.col("c_acctbal") > 8000))
    return reconcile.peers_of(inst, masters, "c_nationkey", ["c_custkey"], "role").select("c_custkey")


@query("mark_absent", """
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_orderstatus ELSE 'offline' END AS o_orderstatus
FROM orders
""")
def mark_absent(spark, d):
    active = table(spark, d, "customer").filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"))
    return reconcile.mark_absent(table(spark, d, "orders"), active, "o_custkey", "o_orderstatus", ["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus"
    )


@query("protect_candidates", """
WITH s AS (SELECT o_custkey, count(*) FILTER (o_orderpriority LIKE '%URGENT%') AS waiting FROM orders GROUP BY 1),
t AS (SELECT o_custkey, waiting, c_custkey % 2 AS slave, c_nationkey * 10 AS lag FROM s JOIN customer ON c_custkey = o_custkey)
SELECT o.o_custkey, o.o_orderkey, t.waiting FROM orders o JOIN t ON t.o_custkey = o.o_custkey
WHERE o.o_orderstatus = 'P' AND waiting > 0 AND (waiting >= 4 OR (slave = 1 AND lag >= 120))
""")
def protect_candidates(spark, d):
    sessions = table(spark, d, "orders")
    inst = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 1, "slave").otherwise("master").alias("role"),
        (F.col("c_nationkey") * 10).alias("lag"),
    )
    out = reconcile.protect_candidates(
        sessions, inst, "o_custkey", F.col("o_orderstatus") == "P", state="o_orderpriority", role="role", lag="lag", session_id="o_orderkey",
        waiting_like="%URGENT%", max_waiting=4,
    )
    return out.select("o_custkey", "o_orderkey", "waiting")


@query("role_and_lag", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '4' THEN 'slave' ELSE 'master' END AS role,
       CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '4' THEN (CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 300 END) ELSE 0 END AS lag FROM orders
""")
def role(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "P", "Connecting").alias("io"),
        F.when(F.col("o_orderpriority") < "4", "Yes").otherwise("No").alias("sql"),
        F.when(F.col("o_custkey") % 9 == 0, "NULL").otherwise((F.col("o_custkey") % 300).cast("string")).alias("behind"),
    )
    return role_and_lag(o, "io", "sql", "behind").select("o_orderkey", "role", "lag")


@query("positions_equal", """
SELECT o_orderkey, (o_orderstatus = 'F' OR o_orderstatus = 'P') AND (o_orderkey % 3 = 0 OR o_orderkey % 3 = 1) AS caught_up FROM orders
""")
def positions(spark, d):
    k = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    o = table(spark, d, "orders").select(
        k, F.when(F.col("o_orderstatus") == "P", null).otherwise(F.lit("f.1")).alias("rf"),
        F.when(F.col("o_orderstatus") == "P", null).when(F.col("o_orderstatus") == "F", "f.1").otherwise("f.2").alias("df"), k.alias("rp"),
        F.when(k % 3 == 2, k + 1).otherwise(k).alias("dp"),
    )
    return positions_equal(o, "rf", "rp", "df", "dp").select("o_orderkey", "caught_up")


def edges(spark, d):
    """Customer n replicates from n div 10; 0 is the top."""
    c = table(spark, d, "customer").filter(F.col("c_custkey") > 0)
    return c.select(
        F.col("c_custkey").alias("child"), F.expr("c_custkey div 10").alias("parent"),
        F.when(F.col("c_custkey") % 17 == 0, "NULL").otherwise((F.col("c_nationkey") % 4).cast("string")).alias("lag"),
    )


EDGES = """
edge AS (SELECT c_custkey AS child, c_custkey // 10 AS parent, CASE WHEN c_custkey % 17 <> 0 THEN c_nationkey % 4 END AS lag
         FROM customer WHERE c_custkey > 0)
"""


@query("walk_chain", f"""
WITH RECURSIVE {EDGES},
w AS (SELECT c_custkey AS node, c_custkey AS root, CAST(0 AS BIGINT) AS depth, CAST(c_custkey AS VARCHAR) AS path FROM customer
      UNION ALL SELECT w.node, e.parent, depth + 1, path || '>' || CAST(e.parent AS VARCHAR) FROM w JOIN edge e ON e.child = w.root AND e.lag < 3)
SELECT node, root, depth, path, CASE WHEN root = 0 THEN 'top' ELSE 'lag' END AS ended FROM w
WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.child = w.root AND e.lag < 3)
""")
def walk_chain(spark, d):
    return chains.walk_chain(edges(spark, d), "child", "parent", "lag", 3)


@query("walk_deep_chain", """
WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT k AS node, min(k) OVER () AS root, n - 1 AS depth, 'top' AS ended,
  CASE WHEN n % 1000 = 7 AND n < 3000 THEN (SELECT string_agg(b.k::VARCHAR, '>' ORDER BY b.n DESC) FROM o b WHERE b.n <= o.n) END AS path
FROM o
""")
def walk_deep_chain(spark, d):
    """One chain of all orders, each below the one before it; the paths of a few are asked for."""
    numbered = number_rows(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    before = numbered.select(F.col("o_orderkey").alias("parent"), (F.col("row_no") + 1).alias("row_no"))
    links = numbered.withColumnRenamed("o_orderkey", "child").join(before, "row_no").select("child", "parent", F.lit(0).alias("lag"))
    asked = numbered.filter("row_no % 1000 = 7 AND row_no < 3000").select("o_orderkey")
    return chains.walk_chain(links, "child", "parent", "lag", 3, paths=asked)


@query("promote_grandparent", f"""
WITH {EDGES}
SELECT a.child, a.parent, b.parent AS proposed FROM edge a JOIN edge b ON a.parent = b.child WHERE a.lag < 3 AND b.lag < 3
""")
def promote_grandparent(spark, d):
    return chains.promote_grandparent(edges(spark, d), "child", "parent", "lag", 3)


@query("shard_calendar", """
WITH r AS (SELECT o_orderstatus, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1)
SELECT o_orderstatus, 'shop_' || strftime(day, '%Y') || '_db.orders_' || strftime(day, '%m%d') AS shard
FROM (SELECT o_orderstatus, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM r)
""")
def shard_calendar(spark, d):
    r = table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e")
    )
    return shards.calendar_for(r, "s", "e", "shop_#yyyy#_db.orders_#mmdd#").select("o_orderstatus", "shard")


@query("shard_coverage", """
WITH present AS (SELECT DISTINCT 'shop_' || strftime(o_orderdate, '%Y') || '_db.orders_' || strftime(o_orderdate, '%m') AS shard FROM orders),
r AS (SELECT min(o_orderdate) + INTERVAL 90 DAY AS lo, max(o_orderdate) + INTERVAL 90 DAY AS hi FROM orders),
expected AS (SELECT DISTINCT 'shop_' || strftime(day, '%Y') || '_db.orders_' || strftime(day, '%m') AS shard
             FROM (SELECT unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS day FROM r))
SELECT coalesce(e.shard, p.shard) AS shard, CASE WHEN p.shard IS NULL THEN 'absent' ELSE 'extra' END AS coverage
FROM expected e FULL JOIN present p ON e.shard = p.shard WHERE e.shard IS NULL OR p.shard IS NULL
""")
def shard_coverage(spark, d):
    from fleetloom.functions.scalars import fill_template

    o = table(spark, d, "orders")
    template = "shop_#yyyy#_db.orders_#mm#"
    present = o.select(fill_template(F.lit(template), F.col("o_orderdate")).alias("shard"))
    # Expected from three months after the first order until three months after the last: some shards are extra, some absent.
    r = o.agg(F.date_add(F.to_date(F.min("o_orderdate")), 90).alias("s"), F.date_add(F.to_date(F.max("o_orderdate")), 90).alias("e"))
    return shards.shard_coverage(shards.calendar_for(r, "s", "e", template), present)


@query("shard_union", """
SELECT o_orderkey, o_totalprice, NULL AS o_orderstatus, NULL AS o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, NULL FROM orders
  WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'
""")
def shard_union(spark, d):
    o = table(spark, d, "orders")
    year = lambda y: F.lit(f"{y}-01-01").cast("timestamp_ntz")
    at = F.col("o_orderdate")
    return shards.shard_union([
        o.filter(at < year(1997)).select("o_orderkey", "o_totalprice"),
        o.filter((at >= year(1997)) & (at < year(1999))).select("o_orderkey", "o_totalprice", "o_orderstatus"),
        o.filter(at >= year(1999)).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"),
    ])


@query("shard_match", """
WITH n AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'shop_' || strftime(o_orderdate, '%Y') || '_db.t_' || strftime(o_orderdate, '%m%d')
             WHEN 1 THEN 'shop_' || strftime(o_orderdate, '%y') || '_db.t_' || strftime(o_orderdate, '%m%d')
             ELSE 'shop_' || strftime(o_orderdate, '%Y') || '_db.t_' || strftime(o_orderdate, '%m%d') || '_old' END AS name FROM orders)
SELECT * FROM n WHERE regexp_full_match(name, 'shop_[0-9]{4}_db\\.t_[0-9]{4}')
""")
def match(spark, d):
    day = F.col("o_orderdate")
    k = F.col("o_orderkey") % 3
    tail = F.concat(F.lit("_db.t_"), F.date_format(day, "MMdd"))
    long = F.concat(F.lit("shop_"), F.date_format(day, "yyyy"), tail)
    short = F.concat(F.lit("shop_"), F.date_format(day, "yy"), tail)
    n = table(spark, d, "orders").select(
        "o_orderkey", F.when(k == 0, long).when(k == 1, short).otherwise(F.concat(long, F.lit("_old"))).alias("name")
    )
    return shard_match(n, "name", "shop_#yyyy#_db.t_#mmdd#")


@query("name_age_filter", """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'other_' ELSE 'log_' END || strftime(o_orderdate, '%Y%m%d') || '07' ||
             CASE WHEN o_orderkey % 7 = 0 THEN '_tail' ELSE '' END AS name, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, name, strftime(day, '%Y-%m-%d') AS name_date FROM n WHERE name LIKE 'log%' AND day < DATE '2001-07-02'
""")
def name_age(spark, d):
    n = table(spark, d, "orders").select("o_orderkey", F.concat(
        F.when(F.col("o_orderkey") % 5 == 0, "other_").otherwise("log_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("07"),
        F.when(F.col("o_orderkey") % 7 == 0, "_tail").otherwise(""),
    ).alias("name"))
    out = name_age_filter(n, "name", "log", dt.date(2001, 8, 1), 30)
    return out.withColumn("name_date", F.col("name_date").cast("string"))


@query("project_catalogue", "SELECT s_suppkey AS machine, s_name AS host, CAST(s_nationkey AS BIGINT) AS port FROM supplier")
def catalogue(spark, d):
    out = project_catalogue(table(spark, d, "supplier"), {"s_suppkey": "machine", "s_name": "host", "s_nationkey": "port"})
    return out.withColumn("port", F.col("port").cast("long"))


@query("estate_sync", """
WITH i AS (SELECT c_custkey % 400 AS type, c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Master' WHEN 1 THEN 'Masterbackup' ELSE 'Slave' END AS role
           FROM customer WHERE c_acctbal > 2000),
m AS (SELECT DISTINCT type FROM i WHERE role = 'Master'),
s AS (SELECT type, arg_min(c_custkey, (CASE role WHEN 'Masterbackup' THEN 1 ELSE 2 END, c_custkey)) AS source_host FROM i WHERE role <> 'Master' GROUP BY 1),
u AS (SELECT type, source_host FROM s SEMI JOIN m USING (type)),
b AS (SELECT s_suppkey AS type, s_suppkey AS source_host, CASE WHEN s_acctbal > 4000 THEN 'online' ELSE 'paused' END AS state,
             CAST(s_nationkey AS BIGINT) AS weekday FROM supplier)
SELECT coalesce(b.type, u.type) AS type, CASE WHEN u.type IS NOT NULL THEN 'net' ELSE 'old' END AS address,
       coalesce(u.source_host, b.source_host) AS source_host, CAST(3306 AS BIGINT) AS source_port,
       CASE WHEN b.type IS NULL THEN 'online' WHEN u.type IS NULL THEN 'offline' ELSE b.state END AS state,
       CASE WHEN b.type IS NULL THEN 9 ELSE b.weekday END AS weekday
FROM b FULL JOIN u ON b.type = u.type
""")
def estate_sync(spark, d):
    """Suppliers as the backup settings of clusters that the customers' instances form."""
    role = F.when(F.col("c_custkey") % 7 == 0, "Master").when(F.col("c_custkey") % 7 == 1, "Masterbackup").otherwise("Slave")
    inst = table(spark, d, "customer").select(
        (F.col("c_custkey") % 400).alias("type"), F.col("c_custkey").alias("server_host"), F.lit(3306).cast("long").alias("server_port"),
        role.alias("role"), F.when(F.col("c_acctbal") > 2000, "online").otherwise("offline").alias("state"),
    )
    info = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("type"), F.lit("old").alias("address"), F.col("s_suppkey").alias("source_host"),
        F.lit(3306).cast("long").alias("source_port"), F.when(F.col("s_acctbal") > 4000, "online").otherwise("paused").alias("state"),
        F.col("s_nationkey").cast("long").alias("weekday"),
    )
    return sync_backup_info(info, inst, "net", {"state": "online", "weekday": 9})
