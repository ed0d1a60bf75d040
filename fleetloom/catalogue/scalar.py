"""One query per group of column helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetloom.catalogue.registry import query, table
from fleetloom.functions import scalars as S


@query("sc_rate", """
SELECT o_orderkey, round(abs((o_totalprice - o_custkey) / nullif(CAST(o_orderkey % 7 AS DOUBLE), 0))) AS rate,
       round(o_totalprice / nullif(CAST(o_custkey % 5 AS DOUBLE), 0), 4) AS share FROM orders
""")
def sc_rate(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k, S.rate(F.col("o_totalprice"), F.col("o_custkey"), k % 7).alias("rate"), S.ratio(F.col("o_totalprice"), F.col("o_custkey") % 5, 4).alias("share")
    )


@query("sc_epoch", """
SELECT event_id, epoch_us(ts) // 1000000 AS seconds, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS back FROM events
""")
def sc_epoch(spark, d):
    s = S.to_epoch(F.col("ts"))
    return table(spark, d, "events").select("event_id", s.alias("seconds"), F.date_format(S.from_epoch(s), "yyyy-MM-dd HH:mm:ss").alias("back"))


@query("sc_minute", """
SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, strftime(ts, '%Y%m%d') AS day,
       strftime(ts, '%Y%m%d%H%M%S') AS compact, epoch_us(ts) // 1000000 % 86400 AS second_of_day FROM events
""")
def sc_minute(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", F.date_format(S.minute_of(ts), "yyyy-MM-dd HH:mm:ss").alias("minute"), S.compact_date(ts).alias("day"),
        S.compact_time(ts).alias("compact"), S.second_of_day(ts).cast("long").alias("second_of_day"),
    )


@query("sc_shift", """
SELECT o_orderkey, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS m, strftime(o_orderdate - INTERVAL 45 DAY, '%Y-%m-%d') AS dd,
       strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS pd, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS pm FROM orders
""")
def sc_shift(spark, d):
    ts, day = F.col("o_orderdate"), F.to_date("o_orderdate")
    fmt = "yyyy-MM-dd"
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format(S.minus_minutes(ts, 90), "yyyy-MM-dd HH:mm").alias("m"), F.date_format(S.minus_days(ts, 45), fmt).alias("dd"),
        S.plus_days(day, 3).cast("string").alias("pd"), S.plus_months(day, 1).cast("string").alias("pm"),
    )


@query("sc_weekday", """
SELECT o_orderkey, dayofweek(o_orderdate) AS weekday,
       strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY + INTERVAL 3 DAY, '%Y-%m-%d') AS wednesday FROM orders
""")
def sc_weekday(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", S.weekday_number(day).cast("long").alias("weekday"), S.day_in_week(day, 3).cast("string").alias("wednesday")
    )


@query("sc_lenient_time", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch_us(o_orderdate) // 1000000 WHEN 1 THEN epoch_us(o_orderdate) // 1000000 END AS seconds,
       CASE WHEN o_orderkey % 4 = 0 THEN epoch_us(o_orderdate) // 1000000 ELSE 0 END AS or_zero, o_orderkey % 4 <> 3 AS valid FROM orders
""")
def sc_lenient_time(spark, d):
    k = F.col("o_orderkey") % 4
    raw = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 2, S.UNKNOWN_TIME).otherwise("soon")
    )
    day = F.when(k == 3, "20011301").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.unix_timestamp(S.lenient_time(raw)).alias("seconds"), S.lenient_epoch(raw).alias("or_zero"), S.is_date(day).alias("valid")
    )


@query("sc_split", """
SELECT o_orderkey, strftime(o_orderdate, '%Y') AS schema_name, o_orderpriority AS table_name, strftime(o_orderdate, '%Y') || '/' || o_orderstatus AS joined
FROM orders
""")
def sc_split(spark, d):
    name = F.concat_ws(".", F.date_format("o_orderdate", "yyyy"), "o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", S.name_part(name, 1).alias("schema_name"), S.name_part(name, -1).alias("table_name"),
        S.join_parts("/", S.name_part(name, 1), F.col("o_orderstatus")).alias("joined"),
    )


@query("sc_names", """
SELECT s_suppkey, 'supplier_' || replace(lower(s_name), '#', '#') AS flat, 'CREATE TABLE ' || s_name || ' ENGINE=x DEFAULT' AS ddl,
       position('#' IN s_name) AS hash_at, translate(s_name, '#S', '-') AS mapped FROM supplier
""")
def sc_names(spark, d):
    quoted = F.concat(F.lit("`supplier`.'"), "s_name", F.lit("'"))
    ddl = F.concat(F.lit("CREATE TABLE "), "s_name", F.lit(" ENGINE=x AUTO_INCREMENT="), F.col("s_suppkey").cast("string"), F.lit(" DEFAULT"))
    return table(spark, d, "supplier").select(
        "s_suppkey", S.flatten_name(quoted).alias("flat"), S.drop_auto_increment(ddl).alias("ddl"),
        S.match_start(F.col("s_name"), "#[0-9]+").cast("long").alias("hash_at"), S.map_chars(F.col("s_name"), "#S", "-").alias("mapped"),
    )


@query("normalise_punctuation", """
SELECT doc_id, md5(text) AS half, md5(translate(text, ',.?!:;', '，。？！：；')) AS full_width FROM documents
""")
def normalise_punctuation(spark, d):
    wide = F.translate("text", ",.?!:;", "，。？！：；")
    return table(spark, d, "documents").select("doc_id", F.md5(S.normalise_punctuation(wide)).alias("half"), F.md5(wide).alias("full_width"))


@query("sc_template", """
SELECT o_orderkey, 'x_' || strftime(o_orderdate, '%Y') || '_db.t_' || strftime(o_orderdate, '%m%d') AS by_day,
       'x_' || strftime(o_orderdate, '%Y') || '_db.t_' || strftime(o_orderdate, '%m') AS by_month FROM orders
""")
def sc_template(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", S.fill_template(F.lit("x_#yyyy#_db.t_#mmdd#"), day).alias("by_day"), S.fill_template(F.lit("x_#yyyy#_db.t_#mm#"), day).alias("by_month")
    )


@query("sc_ids", """
SELECT o_orderkey, '10' || CAST(o_custkey AS VARCHAR) || '1_3306_' || strftime(o_orderdate, '%Y%m%d%H%M%S') AS instance_id,
       upper('t' || CAST(o_custkey AS VARCHAR) || '-' || strftime(o_orderdate, '%Y%m%d') || '-dump') AS task_id FROM orders
""")
def sc_ids(spark, d):
    cust = F.col("o_custkey").cast("string")
    day = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", S.instance_task_id(F.concat(F.lit("10."), cust, F.lit(".1")), F.lit(3306), day).alias("instance_id"),
        S.run_task_id(F.concat(F.lit("t"), cust), day, F.lit("dump")).alias("task_id"),
    )


@query("sc_numbers", """
SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS percent, c_custkey % 9 <> 0 AS numeric,
       c_custkey % 21 + 10 AS bounded FROM customer
""")
def sc_numbers(spark, d):
    raw = F.when(F.col("c_custkey") % 9 == 0, "none").otherwise(F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(
        "c_custkey", S.percent_to_number(F.concat(raw, F.lit("%"))).alias("percent"), S.is_number(raw).alias("numeric"),
        S.bounded_number(F.col("c_custkey"), 10, 30).alias("bounded"),
    )


@query("sc_length", "SELECT doc_id, length(text) AS chars, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def sc_length(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", S.text_length(F.col("text")).cast("long").alias("chars"), S.text_bytes(F.col("text")).cast("long").alias("bytes")
    )


@query("sc_dict_text", """
SELECT o_orderkey, 'h' || CAST(o_custkey AS VARCHAR) AS master_host, CAST(o_custkey AS VARCHAR) AS master_port, o_orderkey AS master_log_pos FROM orders
""")
def sc_dict_text(spark, d):
    cust, pos = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    raw = F.concat(
        F.lit("{u'master_log_pos': "), pos, F.lit("L, 'master_host': u'h"), cust, F.lit("', u'master_port': u'"), cust, F.lit("'}")
    )
    parsed = S.dict_text_to_struct(raw, "master_host string, master_port string, master_log_pos long")
    return table(spark, d, "orders").select("o_orderkey", parsed.alias("p")).select("o_orderkey", "p.*")


@query("sc_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       '{"a":' || CAST(user_id AS VARCHAR) || ',"b":"' || event_type || '"}' AS sorted FROM events
""")
def sc_json(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.from_json("props", "k long")["k"].alias("k"),
        S.to_sorted_json({"b": F.col("event_type"), "a": F.col("user_id")}).alias("sorted"),
    )


@query("sc_ranges", """
SELECT event_id, 60 * (user_id % 60) + 1 AS start_sec, 3600 + user_id % 60 AS end_sec, user_id % 100 + 7 AS second_bound FROM events
""")
def sc_ranges(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    n = F.col("user_id") % 60
    clock = F.concat(F.lit("00:"), two(n), F.lit(":01-01:00:"), two(n))
    rule = F.concat(F.lit("0-"), (F.col("user_id") % 100 + 7).cast("string"), F.lit("-3650"))
    r = S.range_text(clock)
    return table(spark, d, "events").select(
        "event_id", r["start_sec"].cast("long").alias("start_sec"), r["end_sec"].cast("long").alias("end_sec"),
        F.get(S.rule_array(rule), 1).cast("long").alias("second_bound"),
    )
