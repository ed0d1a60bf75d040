"""Rates, gaps, alarms, digests over ``events`` and the order tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetloom.catalogue import registry
from fleetloom.catalogue.registry import query, table
from fleetloom.functions.skew import lookup_join, ordinal_in_key
from fleetloom.operators import alarms, digest, gaps, rates
from fleetloom.operators.tables import pivot_whitelist, threshold_breach, unpivot_metrics
from fleetloom.plans.alarm_path import rate_alarms
from fleetloom.session import pin
from fleetloom.whitelists import RATE_GROUPS

EVENT_TYPES = ["click", "view", "error", "signup", "purchase"]

HOURLY = """
per AS (SELECT event_type, date_trunc('hour', ts) AS slot, max(ts) AS written,
               sum(CAST(round(value * 100) AS BIGINT)) * 1000 AS c FROM events GROUP BY 1, 2),
s AS (SELECT event_type, epoch_us(slot) // 1000000 AS slot, epoch_us(written) // 1000000 AS written,
             CAST(sum(c) OVER (PARTITION BY event_type ORDER BY slot) AS BIGINT) AS bytes FROM per)
"""


def hourly(spark, d):
    """A cumulative counter per event type with one sample per hour that has events."""
    ev = table(spark, d, "events")
    slot = F.date_trunc("hour", "ts").cast("timestamp")
    per = ev.groupBy("event_type", slot.alias("slot")).agg(
        F.max(F.col("ts").cast("timestamp")).alias("written"), (F.sum(F.round(F.col("value") * 100).cast("long")) * 1000).alias("c")
    )
    # At most one row per type and hour.
    return per.withColumn("bytes", F.sum("c").over(Window.partitionBy("event_type").orderBy("slot"))).drop("c")


def epoch(c):
    return F.unix_timestamp(F.col(c)).alias(c)


@query("counter_rate", f"""
WITH {HOURLY}
SELECT a.event_type, a.slot, round(abs((a.bytes - b.bytes) / CAST(a.written - b.written AS DOUBLE))) AS bytes_rate
FROM s a JOIN s b ON a.event_type = b.event_type AND b.slot = a.slot - 3600
WHERE a.bytes <> 0 AND b.bytes <> 0
""")
def counter_rate(spark, d):
    out = rates.counter_rate(hourly(spark, d), ["event_type"], "slot", "written", ["bytes"], 3600)
    return out.select("event_type", epoch("slot"), "bytes_rate")


@query("counter_rate_reset", f"""
WITH {HOURLY},
m AS (SELECT event_type, slot, written, bytes % 5000000 AS bytes FROM s)
SELECT a.event_type, a.slot, a.bytes < b.bytes AS bytes_reset,
       CASE WHEN a.bytes >= b.bytes THEN round(abs((a.bytes - b.bytes) / CAST(a.written - b.written AS DOUBLE))) END AS bytes_rate
FROM m a JOIN m b ON a.event_type = b.event_type AND b.slot = a.slot - 3600
""")
def counter_rate_reset(spark, d):
    wrapped = hourly(spark, d).withColumn("bytes", F.col("bytes") % 5_000_000)
    out = rates.counter_rate(wrapped, ["event_type"], "slot", "written", ["bytes"], 3600, "reset_aware", drop_zero=False)
    return out.select("event_type", epoch("slot"), "bytes_reset", "bytes_rate")


@query("no_result_markers", f"""
WITH {HOURLY}
SELECT a.event_type, a.slot, 'NO_RESULT' AS marker FROM s a
WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.event_type = b.event_type AND b.slot = a.slot - 3600 AND a.bytes <> 0 AND b.bytes <> 0)
""")
def no_result_markers(spark, d):
    s = hourly(spark, d)
    r = rates.counter_rate(s, ["event_type"], "slot", "written", ["bytes"], 3600)
    out = rates.no_result_markers(s, r, ["event_type"], "slot")
    return out.select("event_type", epoch("slot"), "marker")


THROUGHPUT = """
per AS (SELECT user_id % 10 AS grp, date_trunc('hour', ts) AS slot, max(ts) AS written,
               count(*) FILTER (event_type = 'view') * 1000000 AS v, count(*) FILTER (event_type = 'click') * 1000000 AS c,
               count(*) FILTER (event_type = 'error') * 1000000 AS e FROM events GROUP BY 1, 2),
s AS (SELECT grp, epoch_us(slot) // 1000000 AS slot, epoch_us(written) // 1000000 AS written,
             CAST(sum(v) OVER w AS BIGINT) AS v, CAST(sum(c) OVER w AS BIGINT) AS c, CAST(sum(e) OVER w AS BIGINT) AS e
      FROM per WINDOW w AS (PARTITION BY grp ORDER BY slot))
"""


@query("throughput", f"""
WITH {THROUGHPUT},
r AS (SELECT a.grp, a.slot, CAST(nullif(a.written - b.written, 0) AS DOUBLE) AS sec, a.v - b.v AS v, a.c - b.c AS c, a.e - b.e AS e
      FROM s a JOIN s b ON a.grp = b.grp AND b.slot = a.slot - 3600)
SELECT grp, slot, round(abs(v / sec)) AS reads, round(abs(c / sec)) + round(abs(e / sec)) AS transactions FROM r
""")
def throughput(spark, d):
    ev = table(spark, d, "events").withColumn("grp", F.col("user_id") % 10)
    slot = F.date_trunc("hour", "ts").cast("timestamp").alias("slot")
    n = lambda t: (F.count_if(F.col("event_type") == t) * 1_000_000)
    per = ev.groupBy("grp", slot).agg(
        F.max(F.col("ts").cast("timestamp")).alias("written"), n("view").alias("v"), n("click").alias("c"), n("error").alias("e")
    )
    w = Window.partitionBy("grp").orderBy("slot")
    s = per.withColumns({c: F.sum(c).over(w) for c in "vce"})
    out = rates.throughput(s, ["grp"], "slot", "written", {"reads": ["v"], "transactions": ["c", "e"]}, 3600)
    return out.select("grp", epoch("slot"), "reads", "transactions")


@query("throughput_named", f"""
WITH {THROUGHPUT},
r AS (SELECT a.grp, a.slot, CAST(nullif(a.written - b.written, 0) AS DOUBLE) AS sec, a.v - b.v AS v, a.c - b.c AS c, a.e - b.e AS e
      FROM s a JOIN s b ON a.grp = b.grp AND b.slot = a.slot - 3600)
SELECT grp, slot, round(abs((v + c + e) / sec)) AS statements, round(abs(v / sec)) AS reads, round(abs(c / sec)) + round(abs(e / sec)) AS transactions FROM r
""")
def throughput_named(spark, d):
    """The named rates of the status collector: statements, reads, and transactions as commits and rollbacks."""
    ev = table(spark, d, "events").withColumn("grp", F.col("user_id") % 10)
    slot = F.date_trunc("hour", "ts").cast("timestamp").alias("slot")
    n = lambda *t: F.count_if(F.col("event_type").isin(*t)) * 1_000_000
    per = ev.groupBy("grp", slot).agg(
        F.max(F.col("ts").cast("timestamp")).alias("written"), n("view", "click", "error").alias("queries"), n("view").alias("com_select"),
        n("click").alias("com_commit"), n("error").alias("com_rollback"),
    )
    counters = ["queries", "com_select", "com_commit", "com_rollback"]
    s = per.withColumns({c: F.sum(c).over(Window.partitionBy("grp").orderBy("slot")) for c in counters})
    return rates.throughput(s, ["grp"], "slot", "written", RATE_GROUPS, 3600).select("grp", epoch("slot"), *RATE_GROUPS)


ALARMS = f"""
WITH {HOURLY},
r AS (SELECT a.event_type, a.slot, round(abs((a.bytes - b.bytes) / CAST(a.written - b.written AS DOUBLE))) AS bytes_rate
      FROM s a JOIN s b ON a.event_type = b.event_type AND b.slot = a.slot - 3600 WHERE a.bytes <> 0 AND b.bytes <> 0),
lim AS (SELECT event_type, CAST(CASE WHEN event_type = 'error' THEN '500' ELSE '1000' END AS DOUBLE) AS threshold
        FROM (SELECT DISTINCT event_type FROM events))
SELECT r.event_type, r.slot, bytes_rate, threshold, '110' AS alarm_id,
       '[' || r.event_type || '] bytes_rate ' || CAST(CAST(bytes_rate AS BIGINT) AS VARCHAR) || ' (threshold '
           || CAST(CAST(threshold AS BIGINT) AS VARCHAR) || ')' AS content,
       r.slot - 3600 AS range_begin, r.slot AS range_end
FROM r JOIN lim USING (event_type) WHERE bytes_rate > threshold
"""


def type_limits(spark, d):
    """Config tiers from the data: one common limit, and an own limit for the error type."""
    types = table(spark, d, "events").select("event_type").distinct()
    person = types.filter(F.col("event_type") == "error").select(
        F.lit("byte_rate").alias("key"), "event_type", F.lit("500").alias("value"), F.lit("online").alias("state")
    )
    common = types.agg(F.count("*").alias("n")).select(
        F.lit("byte_rate").alias("key"), F.lit("1000").alias("value"), F.lit("online").alias("state")
    )
    return person, common


@query("threshold_join", ALARMS)
def threshold_join(spark, d):
    """The whole alarm path: counter, rate, resolved threshold, alarm."""
    person, common = type_limits(spark, d)
    out = rate_alarms(
        hourly(spark, d), person, common, keys=["event_type"], slot="slot", written="written", counter="bytes",
        config_key="byte_rate", step_seconds=3600, alarm_id="110",
    )
    return out.select(
        "event_type", epoch("slot"), "bytes_rate", "threshold", "alarm_id", "content", epoch("range_begin"), epoch("range_end")
    )


@query("threshold_breach", "SELECT event_id, value FROM events WHERE value > 20.0")
def breach_strict(spark, d):
    return threshold_breach(table(spark, d, "events"), "value", 20.0).select("event_id", "value")


@query("threshold_breach_inclusive", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size >= 40")
def breach_inclusive(spark, d):
    return threshold_breach(table(spark, d, "part"), "p_size", 40, inclusive=True).select("p_partkey", F.col("p_size").cast("long"))


@query("busy_ratio", """
WITH g AS (SELECT l_suppkey, sum(CAST(l_quantity AS BIGINT)) AS u, sum(CAST(l_linenumber AS BIGINT)) AS n,
                  count(*) AS y, sum(CAST(round(l_extendedprice) AS BIGINT)) // 1000 AS idle FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(CAST((u + n + y) * 100 AS DOUBLE) / (u + n + y + idle), 2) AS busy FROM g
""")
def busy_ratio(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("u"), F.sum(F.col("l_linenumber").cast("long")).alias("n"),
        F.count("*").alias("y"), F.floor(F.sum(F.round("l_extendedprice").cast("long")) / 1000).alias("idle"),
    )
    busy = rates.busy_ratio([F.col("u"), F.col("n"), F.col("y")], F.col("idle"))
    return g.select("l_suppkey", busy.alias("busy"))


@query("load_breach", """
SELECT c_custkey, (c_acctbal / 100 > c_nationkey * 70.0 / 100) OR (c_acctbal / 100 > 80) AS overloaded FROM customer
""")
def load_breach(spark, d):
    over = rates.load_breach(F.col("c_acctbal") / 100, F.col("c_nationkey"), F.lit(70.0), F.lit(80))
    return table(spark, d, "customer").select("c_custkey", over.alias("overloaded"))


@query("pivot_whitelist", """
SELECT user_id, nullif(count(*) FILTER (event_type = 'click'), 0) AS f_click, nullif(count(*) FILTER (event_type = 'error'), 0) AS f_error
FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id
""")
def pivot(spark, d):
    raw = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("value"))
    return pivot_whitelist(raw, ["user_id"], "event_type", "value", ["click", "error"], "f_")


@query("pivot_whitelist_folded", """
SELECT user_id, nullif(count(*) FILTER (event_type = 'view'), 0) AS f_view FROM events WHERE event_type = 'view' GROUP BY user_id
""")
def pivot_folded(spark, d):
    raw = table(spark, d, "events").groupBy("user_id", F.initcap("event_type").alias("name")).agg(F.count("*").alias("value"))
    return pivot_whitelist(raw, ["user_id"], "name", "value", ["VIEW"], "f_", fold_case=True)


@query("unpivot_metrics", """
SELECT p_partkey, 'p_size' AS metric, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part
""")
def unpivot(spark, d):
    return unpivot_metrics(table(spark, d, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


SLOTS = """
o AS (SELECT DISTINCT user_id, epoch_us(date_trunc('hour', ts)) // 1000000 AS slot FROM events),
b AS (SELECT user_id, min(slot) AS lo, max(slot) AS hi FROM o GROUP BY 1),
g AS (SELECT user_id, unnest(range(lo, hi + 1, 3600)) AS slot FROM b)
"""


def user_hours(spark, d):
    return table(spark, d, "events").withColumn("slot", F.date_trunc("hour", "ts").cast("timestamp"))


@query("gap_markers", f"WITH {SLOTS} SELECT g.user_id, g.slot AS slot_epoch FROM g ANTI JOIN o ON o.user_id = g.user_id AND o.slot = g.slot")
def gap_markers(spark, d):
    return gaps.gap_markers(user_hours(spark, d), ["user_id"], "slot", 3600)


@query("gap_markers_bounded", """
WITH o AS (SELECT DISTINCT user_id, epoch_us(date_trunc('day', ts)) // 1000000 AS slot FROM events),
g AS (SELECT user_id, unnest(range(1703980800, 1706659200 + 1, 86400)) AS slot_epoch FROM (SELECT DISTINCT user_id FROM o))
SELECT user_id, slot_epoch FROM g WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = g.user_id AND o.slot = g.slot_epoch)
""")
def gap_markers_bounded(spark, d):
    days = table(spark, d, "events").withColumn("slot", F.date_trunc("day", "ts"))
    return gaps.gap_markers(days, ["user_id"], "slot", 86_400, bounds=(1_703_980_800, 1_706_659_200))


@query("gap_islands", f"""
WITH {SLOTS},
m AS (SELECT g.user_id, g.slot, g.slot - 3600 * row_number() OVER (PARTITION BY g.user_id ORDER BY g.slot) AS island
      FROM g ANTI JOIN o ON o.user_id = g.user_id AND o.slot = g.slot)
SELECT user_id, min(slot) AS gap_start, max(slot) AS gap_end, count(*) AS missing FROM m GROUP BY user_id, island
""")
def gap_islands(spark, d):
    return gaps.gap_islands(user_hours(spark, d), ["user_id"], "slot", 3600)


@query("gap_islands_clipped", """
WITH r AS (SELECT min(epoch_us(date_trunc('hour', ts))) // 1000000 + 86400 * 20 AS lo, min(epoch_us(date_trunc('hour', ts))) // 1000000 + 86400 * 40 AS hi FROM events),
o AS (SELECT DISTINCT user_id, epoch_us(date_trunc('hour', ts)) // 1000000 AS slot FROM events),
g AS (SELECT user_id, unnest(range(lo, hi + 1, 3600)) AS slot FROM (SELECT DISTINCT user_id FROM o), r),
m AS (SELECT g.user_id, g.slot, g.slot - 3600 * row_number() OVER (PARTITION BY g.user_id ORDER BY g.slot) AS island
      FROM g ANTI JOIN o ON o.user_id = g.user_id AND o.slot = g.slot)
SELECT user_id, min(slot) AS gap_start, max(slot) AS gap_end, count(*) AS missing FROM m GROUP BY user_id, island
""")
def gap_islands_clipped(spark, d):
    """Gaps inside a range that begins after the first samples and ends before the last."""
    low = table(spark, d, "events").agg(F.min(F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp")))).first()[0]
    return gaps.gap_islands(user_hours(spark, d), ["user_id"], "slot", 3600, bounds=(low + 86_400 * 20, low + 86_400 * 40))


@query("gap_alarm", """
WITH o AS (SELECT DISTINCT user_id, epoch_us(date_trunc('hour', ts)) // 1000000 AS slot FROM events),
n AS (SELECT user_id, slot, lead(slot) OVER (PARTITION BY user_id ORDER BY slot) AS nxt FROM o)
SELECT user_id, slot + 3600 AS gap_start, nxt - 3600 AS gap_end, (nxt - slot) // 3600 - 1 AS missing
FROM n WHERE nxt - slot >= 3600 * 25
""")
def gap_alarm(spark, d):
    return gaps.gap_islands(user_hours(spark, d), ["user_id"], "slot", 3600, min_slots=24)


@query("fill_gaps", f"""
WITH {HOURLY},
b AS (SELECT event_type, min(slot) AS lo, max(slot) AS hi FROM s GROUP BY 1),
g AS (SELECT event_type, unnest(range(lo, hi + 1, 3600)) AS slot FROM b)
SELECT g.event_type, g.slot AS slot_epoch,
       last_value(s.bytes IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.slot) AS bytes, s.bytes IS NULL AS filled
FROM g LEFT JOIN s ON s.event_type = g.event_type AND s.slot = g.slot
""")
def fill_gaps(spark, d):
    return gaps.fill_gaps(hourly(spark, d), ["event_type"], "slot", ["bytes"], 3600)


@query("overdue", """
WITH l AS (SELECT o_custkey, epoch_us(max(o_orderdate)) // 1000000 AS last_seen FROM orders GROUP BY 1)
SELECT o_custkey, last_seen, 996624000 - last_seen AS late_seconds FROM l WHERE 996624000 - last_seen >= 90 * 86400
""")
def overdue(spark, d):
    now = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")
    return gaps.overdue(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", now, 90 * 86_400).select(
        "o_custkey", epoch("last_seen"), "late_seconds"
    )


@query("overdue_expected", """
WITH l AS (SELECT c_custkey AS o_custkey, (SELECT epoch_us(max(o_orderdate)) // 1000000 FROM orders WHERE o_custkey = c_custkey) AS last_seen FROM customer)
SELECT o_custkey, last_seen, 996624000 - last_seen AS late_seconds FROM l WHERE last_seen IS NULL OR 996624000 - last_seen >= 365 * 86400
""")
def overdue_expected(spark, d):
    """Customers without a recent order, those without any included."""
    now = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")
    some = table(spark, d, "orders")
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    late = gaps.overdue(some, ["o_custkey"], "o_orderdate", now, 365 * 86_400, everyone)
    return late.select("o_custkey", epoch("last_seen"), "late_seconds")


@query("fill_gaps_values", """
WITH o AS (SELECT user_id, epoch_us(date_trunc('hour', ts)) // 1000000 AS slot, CAST(max(CASE WHEN event_type = 'click' THEN event_id END) AS BIGINT) AS click,
                  CAST(max(CASE WHEN event_type = 'view' THEN event_id END) AS BIGINT) AS seen FROM events GROUP BY 1, 2),
b AS (SELECT user_id, min(slot) AS lo, max(slot) AS hi FROM o GROUP BY 1),
g AS (SELECT user_id, unnest(range(lo, hi + 1, 3600)) AS slot FROM b)
SELECT g.user_id, g.slot AS slot_epoch, last_value(o.click IGNORE NULLS) OVER w AS click, last_value(o.seen IGNORE NULLS) OVER w AS seen,
       o.click IS NULL OR o.seen IS NULL AS filled
FROM g LEFT JOIN o ON o.user_id = g.user_id AND o.slot = g.slot WINDOW w AS (PARTITION BY g.user_id ORDER BY g.slot)
""")
def fill_gaps_values(spark, d):
    """Hourly series per user with two values, each with holes of its own."""
    latest = lambda t: F.max(F.when(F.col("event_type") == t, F.col("event_id")))
    hours = user_hours(spark, d).groupBy("user_id", "slot").agg(latest("click").alias("click"), latest("view").alias("seen"))
    return gaps.fill_gaps(hours, ["user_id"], "slot", ["click", "seen"], 3600)


@query("capacity_trend", """
WITH p AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS row_count, sum(length(props)) AS bytes
           FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-30' AND CAST(ts AS DATE) > DATE '2023-12-31' GROUP BY 1, 2)
SELECT event_type, CAST(day AS VARCHAR) AS day, row_count, CAST(bytes AS BIGINT) AS bytes,
       row_count - lag(row_count) OVER w AS row_count_growth, CAST(bytes - lag(bytes) OVER w AS BIGINT) AS bytes_growth
FROM p WINDOW w AS (PARTITION BY event_type ORDER BY day)
""")
def capacity_trend(spark, d):
    snap = table(spark, d, "events").select(
        "event_type", F.to_date("ts").alias("day"), F.lit(1).cast("long").alias("row_count"), F.length("props").cast("long").alias("bytes")
    )
    out = gaps.capacity_trend(snap, ["event_type"], "day", ["row_count", "bytes"], F.lit(dt.date(2024, 1, 30)), 30)
    return out.withColumn("day", F.col("day").cast("string"))


def errors(spark, d):
    return table(spark, d, "events").filter(F.col("event_type") == "error").select("user_id", "ts", "event_id")


@query("converge_time", """
WITH e AS (SELECT *, epoch_us(ts) // 1000000 // 300 * 300 AS slot_epoch FROM events WHERE event_type = 'error')
SELECT user_id, slot_epoch, min(event_id) AS event_id, count(*) AS alarms FROM e GROUP BY 1, 2
""")
def converge_time(spark, d):
    return alarms.converge_time(errors(spark, d), ["user_id"], "ts", ["event_id"], 300).drop("ts")


@query("converge_count", """
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal
           FROM events WHERE event_type = 'error')
SELECT * FROM e WHERE (ordinal - 1) % 10 = 0
""")
def converge_count(spark, d):
    return alarms.converge_count(errors(spark, d), ["user_id"], "ts", ["event_id"], 10).select("user_id", "event_id", "ordinal")


@query("converge_exact", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
nxt AS (SELECT a.user_id, a.us, min(b.us) AS us_next FROM e a JOIN e b ON a.user_id = b.user_id AND b.us >= a.us + 86400000000
        GROUP BY 1, 2),
walk AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1
         UNION ALL SELECT w.user_id, n.us_next FROM walk w JOIN nxt n ON w.user_id = n.user_id AND w.us = n.us)
SELECT user_id, us AS sent_us FROM walk
""")
def converge_exact(spark, d):
    return alarms.converge_exact(errors(spark, d), ["user_id"], "ts", 86_400)


@query("converge_exact_hot", registry.ORACLES["converge_exact"])
def converge_exact_hot(spark, d):
    """The same decisions with every key cut into slices."""
    return alarms.converge_exact(errors(spark, d), ["user_id"], "ts", 86_400, hot_share=1_000_000, hot_min_rows=0)


@query("converge_count_hot", registry.ORACLES["converge_count"])
def converge_count_hot(spark, d):
    """The same alarms with every key ranked slice by slice."""
    numbered = ordinal_in_key(errors(spark, d), ["user_id"], "ts", ["event_id"], 86_400, hot_share=1_000_000, hot_min_rows=0)
    return numbered.filter((F.col("ordinal") - 1) % 10 == 0).select("user_id", "event_id", "ordinal")


@query("digest_rollup", """
WITH f AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '''[^'']*''', '?', 'g'), '[0-9]+', '?', 'g'),
                       '[ \\t\\r\\n]+', ' ', 'g')) AS fp, source, n_chars, doc_id, text FROM documents WHERE length(text) > 0)
SELECT md5(fp) AS fp, source, doc_id // 500 AS slot_epoch, count(*) AS calls, CAST(sum(n_chars) AS BIGINT) AS metric_sum,
       min(n_chars) AS metric_min, max(n_chars) AS metric_max, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
       min(doc_id * 60) AS first_seen, max(doc_id * 60) AS last_seen
FROM f GROUP BY ALL
""")
def digest_rollup(spark, d):
    docs = table(spark, d, "documents").withColumn("seen", F.timestamp_seconds(F.col("doc_id") * 60))
    out = digest.digest_rollup(docs, "text", "seen", "n_chars", ["source"], 30_000)
    return out.select(
        F.md5("fingerprint").alias("fp"), "source", F.floor(F.col("slot_epoch") / 30_000).cast("long").alias("slot_epoch"), "calls",
        "metric_sum", "metric_min", "metric_max", "bytes", "first_seen", "last_seen",
    )


@query("digest_percentile", """
WITH f AS (SELECT trim(regexp_replace(regexp_replace(lower(url), '[0-9]+', '?', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS fingerprint, page_id,
                  length(html) AS n FROM pages)
SELECT fingerprint, count(*) AS calls, min(n) AS metric_min, max(n) AS metric_max, quantile_disc(n, 0.95) AS metric_pct FROM f GROUP BY 1
""")
def digest_percentile(spark, d):
    pages = table(spark, d, "pages").withColumns({"seen": F.timestamp_seconds(F.lit(0)), "n": F.length("html").cast("long")})
    out = digest.digest_rollup(pages, "url", "seen", "n", [], 3_600)
    return out.select("fingerprint", "calls", "metric_min", "metric_max", "metric_pct")


@query("digest_daily", """
SELECT event_type AS fingerprint, epoch_us(date_trunc('day', ts)) // 1000000 AS slot_epoch, count(*) AS calls, min(value) AS metric_min, max(value) AS metric_max,
  epoch_us(min(ts)) // 1000000 AS first_seen, epoch_us(max(ts)) // 1000000 AS last_seen, true AS pct_close, true AS users_close
FROM events GROUP BY 1, 2
""")
def digest_daily(spark, d):
    """Days merged from hourly history. The 95th percentile and the users of a day are held against the events themselves."""
    ev = table(spark, d, "events")
    hourly = digest.digest_history(ev, "event_type", "ts", "value", [], 3_600, "user_id")
    daily = pin(digest.digest_read(digest.digest_merge(hourly, [], 86_400)))
    day = (F.floor(F.unix_timestamp("ts") / 86_400) * 86_400).cast("long").alias("slot_epoch")
    events, limits = ev.select(F.col("event_type").alias("fingerprint"), day, "event_id", "user_id", "value"), daily.select("fingerprint", "slot_epoch", "metric_pct")
    at = lookup_join(events, limits, ["fingerprint", "slot_epoch"], "inner", spread=["event_id"])
    exact = at.groupBy("fingerprint", "slot_epoch").agg(
        F.avg((F.col("value") < F.col("metric_pct")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("metric_pct")).cast("double")).alias("up_to"),
        F.count_distinct("user_id").alias("users"),
    )
    close = (F.col("below") <= 0.96) & (F.col("up_to") >= 0.94)
    users = F.abs(F.col("who_count") - F.col("users")) <= 2 + 0.08 * F.col("users")
    return daily.join(exact, ["fingerprint", "slot_epoch"]).select(
        "fingerprint", "slot_epoch", "calls", "metric_min", "metric_max", "first_seen", "last_seen", close.alias("pct_close"), users.alias("users_close")
    )


@query("digest_review", """
WITH f AS (SELECT trim(regexp_replace(regexp_replace(lower(url), '[0-9]+', '?', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS fingerprint, page_id FROM pages)
SELECT fingerprint, min(page_id) AS first_seen, max(page_id) AS last_seen FROM f GROUP BY 1
""")
def digest_review(spark, d):
    pages = table(spark, d, "pages").withColumns({"seen": F.timestamp_seconds("page_id"), "n": F.lit(1)})
    even = digest.digest_rollup(pages.filter(F.col("page_id") % 2 == 0), "url", "seen", "n", [], 100)
    odd = digest.digest_rollup(pages.filter(F.col("page_id") % 2 == 1), "url", "seen", "n", [], 100)
    return digest.digest_review(odd, digest.digest_review(even))


@query("periodic_capture", """
WITH c AS (SELECT event_type, event_id, epoch_us(ts) // 1000000 // 14400 AS cycle, row_number() OVER
             (PARTITION BY event_type, epoch_us(ts) // 1000000 // 14400 ORDER BY ts, event_id) AS rn
           FROM events WHERE epoch_us(ts) // 1000000 % 14400 < 7200)
SELECT event_type, event_id, cycle FROM c WHERE rn <= 3
""")
def periodic_capture(spark, d):
    out = digest.periodic_capture(table(spark, d, "events"), ["event_type"], "ts", ["event_id"], 7_200, 7_200, 3)
    return out.select("event_type", "event_id", "cycle")
