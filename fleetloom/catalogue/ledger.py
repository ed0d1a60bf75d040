"""Backup ledger, upserts, exports: ``orders`` as the ledger of the customers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetloom.catalogue import registry
from fleetloom.catalogue.registry import query, table
from fleetloom.operators import retention, tables, upserts
from fleetloom.plans import backup_catalogue
from fleetloom.session import work_folder
from fleetloom.sources import tables as sinks
from fleetloom.sources import versioned

TODAY = dt.date(2001, 8, 1)
RULE = "0-365-730-1825"

POPULATION = """
pop AS (SELECT o_custkey, o_orderkey, o_orderdate, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age
        FROM orders WHERE o_orderstatus = 'F'),
banded AS (SELECT *, CASE WHEN age > 0 AND age <= 365 THEN 1 WHEN age > 365 AND age <= 730 THEN 2 WHEN age > 730 AND age <= 1825 THEN 3
                          WHEN age > 1825 AND age <= 36600 THEN 4 END AS band FROM pop),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS oldest,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest,
                     row_number() OVER (PARTITION BY o_custkey, band ORDER BY o_orderdate DESC, o_orderkey DESC) AS in_band FROM banded)
"""


@query("tiered_retention", f"""
WITH {POPULATION}
SELECT o_custkey, o_orderkey, age AS age_days, CAST(band AS BIGINT) AS band,
       (oldest = 1 OR newest = 1 OR (band IS NOT NULL AND in_band = 1)) AS kept,
       nullif(concat_ws('+', CASE WHEN band IS NOT NULL AND in_band = 1 THEN 'band' END, CASE WHEN newest = 1 THEN 'newest' END,
                        CASE WHEN oldest = 1 THEN 'oldest' END), '') AS reason
FROM ranked
""")
def tiered_retention(spark, d):
    out = retention.tiered_retention(
        table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], "o_orderdate",
        "o_orderkey", TODAY, RULE, F.col("o_orderstatus") == "F",
    )
    return out.select(
        "o_custkey", "o_orderkey", F.col("age_days").cast("long"), F.col("band").cast("long"), "kept", "reason"
    )


@query("tiered_retention_null_group", """
WITH pop AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 50 END AS grp, o_orderkey, o_orderdate FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY o_orderdate, o_orderkey) AS oldest,
                     row_number() OVER (PARTITION BY grp ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM pop)
SELECT grp, o_orderkey, oldest = 1 OR newest = 1 AS kept FROM ranked
""")
def tiered_retention_null_group(spark, d):
    """Orders without a group keep their oldest and newest row as any other group does."""
    group = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 50).alias("grp")
    rows = table(spark, d, "orders").select(group, "o_orderkey", "o_orderdate")
    return retention.tiered_retention(rows, ["grp"], "o_orderdate", "o_orderkey", TODAY, None).select("grp", "o_orderkey", "kept")


LEDGER = """
led AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'Succ' WHEN 'P' THEN 'Fail' ELSE 'Backing' END AS backup_status,
               CASE WHEN o_orderkey % 11 = 0 THEN 'done' ELSE 'todo' END AS clear_status FROM orders)
"""


def ledger(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "Succ").when(F.col("o_orderstatus") == "P", "Fail").otherwise("Backing")
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), status.alias("backup_status"),
        F.when(F.col("o_orderkey") % 11 == 0, "done").otherwise("todo").alias("clear_status"), F.lit("todo").alias("remote_backup_status"),
    )


@query("clear_list", f"""
WITH {LEDGER},
pop AS (SELECT *, date_diff('day', day, DATE '2001-08-01') AS age FROM led WHERE backup_status = 'Succ' AND clear_status = 'todo'),
banded AS (SELECT *, CASE WHEN age > 0 AND age <= 365 THEN 1 WHEN age > 365 AND age <= 36600 THEN 2 END AS band FROM pop),
ranked AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS oldest,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS newest,
                     row_number() OVER (PARTITION BY o_custkey, band ORDER BY day DESC, o_orderkey DESC) AS in_band FROM banded)
SELECT o_orderkey, 'not kept' AS clear_reason FROM ranked WHERE NOT (oldest = 1 OR newest = 1 OR (band IS NOT NULL AND in_band = 1))
UNION ALL SELECT o_orderkey, 'failed' FROM led WHERE backup_status = 'Fail' AND clear_status <> 'done'
""")
def clear_list(spark, d):
    out = retention.clear_list(ledger(spark, d), ["o_custkey"], "day", "o_orderkey", TODAY, F.lit("0-365"), disk_used=85, disk_limit=80)
    return out.select("o_orderkey", "clear_reason")


@query("latest_usable", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
       arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
""")
def latest_usable(spark, d):
    return retention.latest_usable(
        table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"], F.col("o_orderstatus") == "F"
    )


@query("prefer_role", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY
             CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS rn
           FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM'))
SELECT o_custkey, o_orderpriority, o_orderkey FROM r WHERE rn = 1
""")
def prefer_role(spark, d):
    return retention.prefer_role(
        table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "3-MEDIUM"], ["o_orderkey"], ["o_orderkey"]
    )


@query("status_rollup", """
SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'Fail' ELSE 'Succ' END AS exec_status, count(*) AS chunks,
       CAST(sum(l_linenumber) AS BIGINT) AS row_count FROM lineitem GROUP BY 1
""")
def status_rollup(spark, d):
    li = table(spark, d, "lineitem").withColumn("status", F.when(F.col("l_returnflag") == "R", "Fail").otherwise("Succ"))
    return retention.status_rollup(li, ["l_orderkey"], "status", "l_linenumber")


@query("run_summary", f"""
WITH {LEDGER}
SELECT strftime(day, '%Y%m') AS run, count(*) FILTER (backup_status = 'Succ') AS succeeded, count(*) FILTER (backup_status = 'Fail') AS failed,
       count(*) FILTER (backup_status = 'Backing') AS unfinished FROM led GROUP BY 1
""")
def run_summary(spark, d):
    return retention.run_summary(ledger(spark, d).withColumn("run", F.date_format("day", "yyyyMM")), ["run"], "backup_status")


@query("gate_counts", """
SELECT count(*) FILTER (o_orderstatus = 'P') AS open_rows, count(*) FILTER (o_totalprice > 300000) AS large_rows,
       count(*) FILTER (o_orderpriority LIKE '%URGENT%') AS urgent_rows FROM orders
""")
def gate_counts(spark, d):
    return retention.gate_counts(table(spark, d, "orders"), {
        "open_rows": F.col("o_orderstatus") == "P", "large_rows": F.col("o_totalprice") > 300_000,
        "urgent_rows": F.col("o_orderpriority").like("%URGENT%"),
    })


@query("pair_summary", """
SELECT l_returnflag AS mode, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS runs, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_size,
       max(l_linenumber * 60) AS longest_seconds FROM lineitem GROUP BY 1, 2
""")
def pair_summary(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("mode"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_quantity").cast("long").alias("size"),
        F.col("l_shipdate").cast("timestamp").alias("start_time"),
        F.timestamp_seconds(F.unix_timestamp("l_shipdate") + F.col("l_linenumber") * 60).alias("end_time"),
    )
    return retention.pair_summary(li, ["mode", "month"], "size", "start_time", "end_time")


@query("next_action", """
WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1)
SELECT c_custkey AS o_custkey, CASE WHEN s IS NULL THEN 'start' WHEN s = 'P' THEN 'check' WHEN s = 'F' THEN 'none' ELSE 'retry' END AS action
FROM customer LEFT JOIN l ON o_custkey = c_custkey
""")
def next_action(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "Backing").when(F.col("o_orderstatus") == "F", "Succ").otherwise("Fail")
    led = table(spark, d, "orders").withColumn("status", status)
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return tables.next_actions(tasks, led, ["o_custkey"], "status", ["o_orderdate", "o_orderkey"]).select("o_custkey", "action")


@query("due_tasks", """
WITH i AS (SELECT c_custkey, c_name, CASE c_mktsegment WHEN 'BUILDING' THEN 'online' WHEN 'MACHINERY' THEN 'ONLINE' ELSE 'offline' END AS mode_state,
                  c_nationkey % 11 AS weekday FROM customer WHERE c_acctbal > 0),
due AS (SELECT c_name, upper(c_name || '-20010801-dump') AS task_id FROM i
        WHERE lower(mode_state) = 'online' AND (weekday = 9 OR (weekday BETWEEN 0 AND 6 AND weekday <= 3))),
led AS (SELECT upper(c_name || '-20010801-dump') AS task_id, arg_max(o_orderstatus, o_orderkey) AS s
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT due.c_name AS type, 'dump' AS mode, task_id,
       CASE WHEN s IS NULL THEN 'start' WHEN s = 'P' THEN 'check' WHEN s = 'F' THEN 'none' ELSE 'retry' END AS action
FROM due LEFT JOIN led USING (task_id)
""")
def due_tasks(spark, d):
    cust = table(spark, d, "customer")
    mode_state = F.when(F.col("c_mktsegment") == "BUILDING", "online").when(F.col("c_mktsegment") == "MACHINERY", "ONLINE").otherwise("offline")
    info = cust.select(
        F.col("c_name").alias("type"), F.lit("dump").alias("mode"), mode_state.alias("mode_state"), (F.col("c_nationkey") % 11).alias("weekday"),
        F.when(F.col("c_acctbal") > 0, "online").otherwise("offline").alias("state"),
    )
    status = F.when(F.col("o_orderstatus") == "P", "Backing").when(F.col("o_orderstatus") == "F", "Succ").otherwise("Fail")
    newest = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by(F.struct(status.alias("backup_status"), F.col("o_orderdate").alias("start_time")), "o_orderkey").alias("r")
    )
    led = newest.join(cust.select("c_custkey", "c_name"), "c_custkey").select(
        F.upper(F.concat("c_name", F.lit("-20010801-dump"))).alias("task_id"), "r.*"
    )
    return backup_catalogue.due_tasks(info, led, TODAY)


@query("keep_union", """
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1
UNION SELECT o_custkey, max(o_orderkey) FROM orders GROUP BY 1
""")
def keep_union(spark, d):
    o = table(spark, d, "orders")
    return tables.keep_union(
        o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    )


@query("minus_keep", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)
""")
def minus_keep(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    keep = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return tables.minus_keep(o, keep, ["o_custkey", "o_orderkey"]).select("o_orderkey")


def customers(spark, d):
    """Old rows, and a batch that changes every third customer, twice for some, and adds new ones."""
    c = table(spark, d, "customer")
    old = c.filter(F.col("c_custkey") % 10 != 0)
    batch = c.filter(F.col("c_custkey") % 3 == 0).select(
        "c_custkey", F.explode(F.when(F.col("c_custkey") % 6 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("seq"),
        "c_name", (F.col("c_acctbal") + 1000).alias("c_acctbal"),
    ).withColumn("c_name", F.concat("c_name", F.lit("/"), F.col("seq").cast("string")))
    return old, batch


@query("upsert_replace", """
WITH b AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 6 = 0 THEN '/2' ELSE '/1' END AS c_name, c_acctbal + 1000 AS c_acctbal
           FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE c_custkey % 10 <> 0 AND c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, c_name, 0, c_acctbal, '' FROM b
""")
def upsert_replace(spark, d):
    old, batch = customers(spark, d)
    out = upserts.upsert_replace(old, batch, ["c_custkey"], ["seq"], {"c_nationkey": 0, "c_mktsegment": ""})
    return out.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


@query("upsert_partial", """
WITH b AS (SELECT c_custkey, c_name || CASE WHEN c_custkey % 6 = 0 THEN '/2' ELSE '/1' END AS c_name, c_acctbal + 1000 AS c_acctbal
           FROM customer WHERE c_custkey % 3 = 0),
o AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0)
SELECT coalesce(o.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL THEN o.c_name ELSE b.c_name END AS c_name,
       CAST(o.c_nationkey AS BIGINT) AS c_nationkey, coalesce(b.c_acctbal, o.c_acctbal) AS c_acctbal, o.c_mktsegment
FROM o FULL JOIN b ON o.c_custkey = b.c_custkey
""")
def upsert_partial(spark, d):
    old, batch = customers(spark, d)
    out = upserts.upsert_partial(old, batch, ["c_custkey"], ["c_acctbal"], ["seq"])
    return out.withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


def in_buckets(spark, d, rows, keys, label, bucket_rows=None):
    path = work_folder(spark, label)
    versioned.create_versioned(rows, path, keys, 16 if bucket_rows is None else max(16, rows.count() // bucket_rows))
    return path


@query("upsert_replace_buckets", registry.ORACLES["upsert_replace"])
def upsert_replace_buckets(spark, d):
    """The same rows from a bucketed table after one batch."""
    old, batch = customers(spark, d)
    path = in_buckets(spark, d, old, ["c_custkey"], "customers")
    versioned.merge_batch(spark, path, batch, ["seq"], defaults={"c_nationkey": 0, "c_mktsegment": ""})
    return versioned.read_version(spark, path).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


@query("upsert_partial_buckets", registry.ORACLES["upsert_partial"])
def upsert_partial_buckets(spark, d):
    """The same rows from a bucketed table after two batches, of which each has half of the customers."""
    old, batch = customers(spark, d)
    path = in_buckets(spark, d, old, ["c_custkey"], "customers")
    for half in range(2):
        versioned.merge_batch(spark, path, batch.filter(F.col("c_custkey") % 2 == half), ["seq"], update=["c_acctbal"])
    return versioned.read_version(spark, path).withColumn("c_nationkey", F.col("c_nationkey").cast("long"))


@query("bounded_delete_steps", """
WITH gone AS (SELECT count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
SELECT 'left' AS what, o_orderkey AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'
UNION ALL SELECT 'step', CASE WHEN i < n // 20000 THEN 20000 ELSE n % 20000 END FROM (SELECT n, unnest(range(n // 20000 + (n % 20000 > 0)::BIGINT)) AS i FROM gone)
""")
def bounded_delete_steps(spark, d):
    """Old orders deleted from a bucketed table in steps of 20,000: the sizes of the steps and what is left."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    # A step rewrites its buckets whole, so their size must not grow with the table.
    path = in_buckets(spark, d, o, ["o_orderkey"], "orders", bucket_rows=50_000)
    steps = versioned.bounded_delete(spark, path, F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), 20_000)
    left = versioned.read_version(spark, path).select(F.lit("left").alias("what"), F.col("o_orderkey").alias("n"))
    return left.unionByName(spark.createDataFrame([("step", n) for _, n in steps], "what string, n long"))


@query("load_replace", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
WHERE o_orderdate < TIMESTAMP '1998-01-01' OR o_orderkey % 4 = 0
""")
def load_replace(spark, d):
    o = table(spark, d, "orders")
    copy = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_totalprice")
    extract = o.filter(F.col("o_orderkey") % 4 == 0).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("n"))
    return sinks.load_replace(copy, extract, ["o_orderkey"], ["n"])


@query("route_by_date", """
SELECT 'shop_' || strftime(o_orderdate, '%Y') || '_db' AS shard_schema, 'orders_' || strftime(o_orderdate, '%m%d') AS shard_table,
       count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1, 2
""")
def route_by_date(spark, d):
    from fleetloom.operators.shards import shard_columns

    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    routed = o.withColumns(shard_columns("shop_db.orders", F.col("o_orderdate")))
    return routed.groupBy("shard_schema", "shard_table").agg(F.count("*").alias("row_count"), F.sum("o_orderkey").alias("key_sum"))


@query("route_by_date_written", """
SELECT 'shop_' || strftime(o_orderdate, '%Y') || '_db' AS shard_schema, 'orders_' || strftime(o_orderdate, '%m') AS shard_table,
       count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY 1, 2
""")
def route_written(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    back = sinks.route_by_date(o, "shop_db.orders", "o_orderdate", work_folder(spark, "route"), by="month")
    return back.groupBy("shard_schema", "shard_table").agg(F.count("*").alias("row_count"), F.sum("o_orderkey").alias("key_sum"))


@query("export_chunked", """
SELECT o_orderpriority, count(*) AS row_count, true AS within_limit FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1
""")
def export_chunked(spark, d):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    manifest = sinks.export_chunked(table(spark, d, "orders"), "o_orderpriority", work_folder(spark, "export"), 500, names)
    return manifest.groupBy("o_orderpriority").agg(
        F.sum("file_rows").alias("row_count"), (F.max("file_rows") <= 500).alias("within_limit")
    )


@query("restore_latest", """
SELECT o_orderstatus, count(*) AS row_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders
WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1
""")
def restore_latest(spark, d):
    """Three exports of the orders; the newest one failed, so the second is restored."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    root = work_folder(spark, "exports")
    runs = []
    for year, status in ((1998, "Succ"), (2000, "Succ"), (2001, "Fail")):
        path = f"{root}/{year}"
        o.filter(F.col("o_orderdate") < F.lit(f"{year}-01-01").cast("timestamp_ntz")).write.parquet(path)
        runs.append(("shop", dt.date(year, 1, 1), path, status, "todo"))
    led = spark.createDataFrame(runs, "instance string, date date, path string, backup_status string, clear_status string")
    usable = (F.col("backup_status") == "Succ") & (F.col("clear_status") == "todo")
    back = sinks.restore_latest(spark, led, "instance", "shop", ["date"], "path", usable)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("row_count"), F.sum("o_orderkey").alias("key_sum"))


@query("ensure_table", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, true AS created, false AS created_again FROM nation")
def ensure_table(spark, d):
    """Creates a table with the source's columns, loads it, and reads it back."""
    n = table(spark, d, "nation")
    path = work_folder(spark, "table")
    name = "nation_copy_" + path.rsplit("-", 1)[1][:12]
    created = sinks.ensure_table(n, name, path)
    again = sinks.ensure_table(n, name, path)
    n.write.insertInto(name)
    return spark.table(name).select(
        F.col("n_nationkey").cast("long"), "n_name", F.lit(created).alias("created"), F.lit(again).alias("created_again")
    )


@query("export_dump", "SELECT l_returnflag, count(*) AS row_count, true AS within_limit FROM lineitem GROUP BY 1")
def export_dump(spark, d):
    """The largest table in files of at most a million rows."""
    manifest = sinks.export_chunked(table(spark, d, "lineitem"), "l_returnflag", work_folder(spark, "dump"), 1_000_000)
    return manifest.groupBy("l_returnflag").agg(
        F.sum("file_rows").alias("row_count"), (F.max("file_rows") <= 1_000_000).alias("within_limit")
    )
