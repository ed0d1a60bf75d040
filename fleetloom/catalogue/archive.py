"""Archiving over ``orders`` and ``lineitem``."""

from __future__ import annotations

import datetime as dt
import uuid
from itertools import combinations

from pyspark.sql import functions as F

from fleetloom.catalogue.registry import query, table
from fleetloom.operators import archive
from fleetloom.operators.tables import key_range, older_than
from fleetloom.plans.archive_run import audit_chunks, run_archive
from fleetloom.session import pin, work_folder

TODAY = dt.date(1998, 1, 31)
CUT = "TIMESTAMP '1998-01-01'"


@query("older_than", f"SELECT o_orderkey FROM orders WHERE o_orderdate < {CUT}")
def older(spark, d):
    return older_than(table(spark, d, "orders"), "o_orderdate", TODAY, 30).select("o_orderkey")


@query("older_than_epoch", f"SELECT o_orderkey FROM orders WHERE epoch_us(o_orderdate) // 1000000 < epoch_us({CUT}) // 1000000 + 1")
def older_epoch(spark, d):
    o = table(spark, d, "orders").withColumn("at", F.unix_timestamp("o_orderdate"))
    return older_than(o, "at", TODAY, 30).select("o_orderkey")


@query("key_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def closed_range(spark, d):
    return key_range(table(spark, d, "orders"), "o_orderkey", 100, 5000).select("o_orderkey", "o_totalprice")


@query("key_range_half_open", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def half_open_range(spark, d):
    return key_range(table(spark, d, "orders"), "o_orderkey", 100, 5000, closed="left").select("o_orderkey")


@query("key_bounds", f"SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS row_count FROM orders WHERE o_orderdate < {CUT}")
def key_bounds(spark, d):
    return archive.key_bounds(older_than(table(spark, d, "orders"), "o_orderdate", TODAY, 30), "o_orderkey")


CHUNKS = f"""
WITH n AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk_no FROM orders WHERE o_orderdate < {CUT})
SELECT chunk_no, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS chunk_rows FROM n GROUP BY 1
"""


@query("keyset_chunks", CHUNKS)
def keyset_chunks(spark, d):
    return archive.keyset_chunks(older_than(table(spark, d, "orders"), "o_orderdate", TODAY, 30), ["o_orderkey"], 1000)


@query("bounded_delete", CHUNKS.replace("1000", "250"))
def bounded_delete(spark, d):
    """The ranges a bounded delete would remove, at most 250 rows each."""
    return archive.keyset_chunks(older_than(table(spark, d, "orders"), "o_orderdate", TODAY, 30), ["o_orderkey"], 250)


@query("archive_split", f"""
SELECT CASE WHEN l_shipdate < {CUT} THEN 'archived' ELSE 'kept' END AS side, count(*) AS row_count,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS VARCHAR) AS total FROM lineitem GROUP BY 1
""")
def archive_split(spark, d):
    s = archive.archive_split(table(spark, d, "lineitem"), "l_shipdate", TODAY, 30)
    return s.sided.groupBy("side").agg(
        F.count("*").alias("row_count"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("string").alias("total")
    )


@query("archive_sides", f"""
SELECT 'archived' AS side, l_orderkey, l_linenumber, l_shipdate < {CUT} AS old FROM lineitem WHERE l_shipdate < {CUT}
UNION ALL SELECT 'kept', l_orderkey, l_linenumber, false FROM lineitem WHERE l_shipdate >= {CUT} OR l_shipdate IS NULL
""")
def archive_sides(spark, d):
    s = archive.archive_split(table(spark, d, "lineitem"), "l_shipdate", TODAY, 30)
    rows = lambda df, side, old: df.select(F.lit(side).alias("side"), "l_orderkey", F.col("l_linenumber"), F.lit(old).alias("old"))
    return rows(s.archived, "archived", True).unionByName(rows(s.kept, "kept", False))


@query("archive_run", f"""
SELECT 'orders_19980131' AS task_id, 'Succ' AS exec_status, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS chunks, count(*) AS row_count
FROM orders WHERE o_orderdate < {CUT}
""")
def archive_run(spark, d):
    """Writes both sides and the audit, and reads the task row back from what was written."""
    out = work_folder(spark, "archive")
    return run_archive(table(spark, d, "orders"), "o_orderdate", TODAY, 30, ["o_orderkey"], 1000, out, "orders_19980131")


@query("archive_run_empty", "SELECT 'none' AS task_id, 'Succ' AS exec_status, CAST(0 AS BIGINT) AS chunks, count(*) AS row_count FROM orders WHERE o_orderdate < TIMESTAMP '1900-01-01'")
def archive_run_empty(spark, d):
    """A run that finds nothing old says so."""
    return run_archive(table(spark, d, "orders"), "o_orderdate", TODAY, 100_000, ["o_orderkey"], 1000, work_folder(spark, "archive"), "none")


@query("archive_audit", f"""
WITH o AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk_no FROM orders WHERE o_orderdate < {CUT})
SELECT chunk_no, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS chunk_rows, count_if(o_orderkey % 5000 <> 0) AS written_rows,
       CASE WHEN count_if(o_orderkey % 5000 = 0) > 0 THEN 'Fail' ELSE 'Succ' END AS exec_status FROM o GROUP BY 1
""")
def archive_audit(spark, d):
    """The audit of a copy that has lost some rows: the chunks they belong to fail."""
    old = archive.archive_split(table(spark, d, "orders"), "o_orderdate", TODAY, 30).archived
    audit = audit_chunks(old, old.filter(F.col("o_orderkey") % 5000 != 0), ["o_orderkey"], 1000, "t")
    return audit.select("chunk_no", F.col("first_key.o_orderkey").alias("first_key"), F.col("last_key.o_orderkey").alias("last_key"), "chunk_rows", "written_rows", "exec_status")


@query("footprint", """
SELECT l_returnflag, l_linestatus, round(CAST(sum(CAST(l_quantity AS BIGINT) * 100 + l_linenumber) AS DOUBLE) / 1024 / 1024, 4) AS size_mb,
       count(*) AS table_rows, count(DISTINCT date_trunc('month', l_shipdate)) AS parts
FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1, 2
""")
def footprint(spark, d):
    li = older_than(table(spark, d, "lineitem"), "l_shipdate", TODAY, 30)
    parts = li.groupBy("l_returnflag", "l_linestatus", F.date_trunc("month", "l_shipdate").alias("part")).agg(
        F.sum(F.col("l_quantity").cast("long") * 100).alias("data"), F.sum(F.col("l_linenumber").cast("long")).alias("idx"),
        F.count("*").alias("n"),
    )
    return archive.footprint(parts, ["l_returnflag", "l_linestatus"], "data", "idx", "n")


@query("retirable_parts", """
SELECT strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '''%Y-%m-%d''') AS bound, count(*) AS row_count FROM orders
WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH < TIMESTAMP '1998-01-31' GROUP BY 1
""")
def retirable(spark, d):
    bound = F.date_format(F.add_months(F.trunc(F.to_date("o_orderdate"), "month"), 1), "''yyyy-MM-dd''")
    parts = table(spark, d, "orders").groupBy(bound.alias("bound")).agg(F.count("*").alias("row_count"))
    return archive.retirable_parts(parts, "bound", TODAY)


@query("retire_partitions", """
SELECT strftime(o_orderdate, '%Y-%m-01') AS month, CASE WHEN date_trunc('month', o_orderdate) < TIMESTAMP '1998-01-31' - INTERVAL 2 YEAR THEN 'retired' ELSE 'kept' END AS state,
  count(*) AS row_count, true AS has_size FROM orders GROUP BY 1, 2
""")
def retire(spark, d):
    """The orders as a table by month; months over two years old are dropped and reported, the rest is read back."""
    name = f"orders_by_month_{uuid.uuid4().hex}"
    month = F.date_format(F.trunc(F.to_date("o_orderdate"), "month"), "yyyy-MM-dd")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", month.alias("month"))
    rows.hint("rebalance", F.col("month")).write.option("path", work_folder(spark, "months")).partitionBy("month").saveAsTable(name)
    gone = archive.retire_run(spark, name, "month", dt.date(TODAY.year - 2, TODAY.month, TODAY.day), page=7)
    # Pinned, as the table goes away with this query.
    left = pin(archive.partition_sizes(spark.table(name), "month"))
    spark.sql(f"DROP TABLE {name}")
    both = gone.withColumn("state", F.lit("retired")).unionByName(left.withColumn("state", F.lit("kept")))
    return both.select(F.col("value").alias("month"), "state", "row_count", (F.col("size_mb") > 0).alias("has_size"))


@query("key_profile", """
SELECT * FROM (
SELECT 'event_id' AS column_name, 'bigint' AS column_type, count(*) AS row_count, count(DISTINCT event_id) AS distinct_values,
       count(*) - count(event_id) AS nulls, count(*) = count(DISTINCT event_id) AS usable FROM events
UNION ALL SELECT 'user_id', 'bigint', count(*), count(DISTINCT user_id), count(*) - count(user_id), count(*) = count(DISTINCT user_id) FROM events
UNION ALL SELECT 'ts', 'timestamp_ntz', count(*), count(DISTINCT ts), count(*) - count(ts), count(*) = count(DISTINCT ts) FROM events)
""")
def key_profile(spark, d):
    return archive.key_profile(table(spark, d, "events"), ["event_id", "user_id", "ts"])


KEY_COLUMNS = {"conversations": ["conv_id", "turn", "role"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]}


def key_sql(most=3):
    """Every set of columns that is unique and has no part that is, one table after the other."""
    parts, ctes = [], []
    for name, columns in KEY_COLUMNS.items():
        sets = [s for size in range(1, most + 1) for s in combinations(columns, size)]
        flags = ", ".join(f"count(*) = count(DISTINCT ({', '.join(s)})) AS k_{'_'.join(s)}" for s in sets)
        for s in sets:
            smaller = "".join(f" AND NOT k_{'_'.join(x)}" for x in sets if set(x) < set(s))
            parts.append(f"SELECT '{name}' AS table_name, '{','.join(s)}' AS key_columns, {len(s)} AS size FROM {name[0]} WHERE k_{'_'.join(s)}{smaller}")
        ctes.append(f"{name[0]} AS MATERIALIZED (SELECT {flags} FROM {name})")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


@query("unique_keys", key_sql())
def unique_keys(spark, d):
    """Minimal keys of up to three columns of the conversations and of the line items."""
    found = [(name, k) for name, columns in KEY_COLUMNS.items() for k in archive.unique_keys(table(spark, d, name), columns, 3)]
    return spark.createDataFrame([(name, ",".join(k), len(k)) for name, k in found], "table_name string, key_columns string, size int")
