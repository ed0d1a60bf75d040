"""Text formats. The texts are made by Spark from table rows, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetloom.catalogue.registry import query, table
from fleetloom.sources import text

TIME = "yyyy-MM-dd HH:mm:ss"


@query("scan_kv_lines", """
SELECT p_partkey, 'part_' || CAST(p_partkey AS VARCHAR) AS key, p_name || ' = ' || p_type AS value FROM part WHERE p_partkey % 4 < 2
""")
def scan_kv_lines(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("part_"), k.cast("string"))
    value = F.concat("p_name", F.lit(" = "), "p_type")
    line = (
        F.when(k % 4 == 0, F.concat(name, F.lit("="), value)).when(k % 4 == 1, F.concat(name, F.lit("  =   "), value, F.lit("  ")))
        .when(k % 4 == 2, "[conf]").otherwise(F.concat(F.lit("# "), name, F.lit("="), value))
    )
    return text.scan_kv_lines(table(spark, d, "part").select("p_partkey", line.alias("value")))


@query("parse_section_metadata", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'up' || CAST(o_custkey AS VARCHAR) ELSE 'src' || CAST(o_custkey AS VARCHAR) END AS master_host,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 3307 ELSE 3306 END AS BIGINT) AS master_port,
       CASE WHEN o_orderkey % 3 = 0 THEN 'binlog.1' ELSE 'binlog.0' END || CAST(o_custkey AS VARCHAR) AS master_log_file,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS master_log_pos,
       CASE WHEN o_orderkey % 10 <> 0 THEN epoch_us(o_orderdate) // 1000000 END AS start_time,
       epoch_us(o_orderdate) // 1000000 + o_orderkey % 3600 AS end_time
FROM orders
""")
def parse_section_metadata(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    begin = F.date_format("o_orderdate", TIME)
    end = F.date_format(F.timestamp_seconds(F.unix_timestamp("o_orderdate") + k % 3600), TIME)
    slave = F.when(k % 3 != 1, F.concat(
        F.lit("SHOW SLAVE STATUS:\n\tHost: up"), c, F.lit("\n\tLog: binlog.1"), c, F.lit("\n\tPos: "), (k + 1).cast("string"), F.lit("\n\tGTID:\n")
    )).otherwise("")
    body = F.concat(
        F.lit("Started dump at: "), F.when(k % 10 == 0, "1970-01-01 00:00:00").otherwise(begin), F.lit("\nSHOW MASTER STATUS:\n\tLog: binlog.0"), c,
        F.lit("\n\tPos: "), k.cast("string"), F.lit("\n\tGTID:\n\n"), slave, F.lit("Finished dump at: "), end, F.lit("\n"),
    )
    files = table(spark, d, "orders").select("o_orderkey", c.alias("c"), body.alias("text"), k.alias("k"))
    io, sql = F.when(F.col("k") % 3 != 1, "Yes"), F.when(F.col("k") % 3 == 0, "Yes").otherwise("No")
    out = text.parse_section_metadata(
        files, "text", F.concat(F.lit("src"), "c"), F.lit(3306), io, sql, F.concat(F.lit("up"), "c"), F.lit(3307), ["o_orderkey"]
    )
    return out.select(
        "o_orderkey", "master_host", F.col("master_port").cast("long"), "master_log_file", "master_log_pos",
        F.unix_timestamp("start_time").alias("start_time"), F.unix_timestamp("end_time").alias("end_time"),
    )


@query("parse_info_metadata", """
SELECT o_orderkey, 'src' || CAST(o_custkey AS VARCHAR) AS master_host, CAST(3306 AS BIGINT) AS master_port,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'binlog.' || CAST(o_custkey AS VARCHAR) END AS master_log_file,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS master_log_pos, epoch_us(o_orderdate) // 1000000 AS start_time,
       CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate) // 1000000 END AS end_time
FROM orders
""")
def parse_info_metadata(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    at = F.date_format("o_orderdate", TIME)
    position = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("filename 'binlog."), c, F.lit("', position '"), k.cast("string"), F.lit("'")))
    body = F.concat(
        F.lit("uuid = 1\nname = \ntool_command = --host=h --port=1\nstart_time = "), at, F.lit("\nend_time = "),
        F.when(k % 7 == 0, "1970-01-01 00:00:00").otherwise(at), F.lit("\nlock_time = 0\nbinlog_pos = "), position, F.lit("\ncompact = N\n"),
    )
    files = table(spark, d, "orders").select("o_orderkey", c.alias("c"), body.alias("text"))
    out = text.parse_info_metadata(files, "text", F.concat(F.lit("src"), "c"), F.lit(3306), ["o_orderkey"])
    return out.select(
        "o_orderkey", "master_host", F.col("master_port").cast("long"), "master_log_file", "master_log_pos",
        F.unix_timestamp("start_time").alias("start_time"), F.unix_timestamp("end_time").alias("end_time"),
    )


@query("scan_log_lines", """
SELECT event_id, CASE WHEN event_id % 5 < 4 THEN epoch_us(ts) // 1000000 END AS ts,
       CASE event_id % 5 WHEN 0 THEN event_type || '.py' WHEN 3 THEN event_type || '.py' END AS file,
       CASE WHEN event_id % 5 = 3 THEN 'INFO' END AS level, CASE WHEN event_id % 5 < 4 THEN props END AS message,
       CASE WHEN event_id % 5 = 4 THEN 'no time ' || props END AS rejected
FROM events
""")
def scan_log_lines(spark, d):
    k = F.col("event_id") % 5
    at = F.date_format("ts", TIME)
    line = (
        F.when(k == 0, F.concat(F.lit("["), at, F.lit(" "), "event_type", F.lit(".py]:"), "props"))
        .when(k == 1, F.concat(F.lit("\x1b[0;35m["), at, F.lit("] "), "props", F.lit("\x1b[0m")))
        .when(k == 2, F.concat(F.lit("["), at, F.lit("] "), "props"))
        .when(k == 3, F.concat(F.lit("["), at, F.lit("] ["), "event_type", F.lit(".py] [12-MainThread] [INFO] ["), "props", F.lit("]")))
        .otherwise(F.concat(F.lit("no time "), "props"))
    )
    out = text.scan_log_lines(table(spark, d, "events").select("event_id", line.alias("value")))
    return out.withColumn("ts", F.unix_timestamp("ts"))
