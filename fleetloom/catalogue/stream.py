"""Streams over files that Spark writes from the tables, or over the table file itself."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from fleetloom.catalogue import registry
from fleetloom.catalogue.registry import table
from fleetloom.catalogue.telemetry import ALARMS, hourly
from fleetloom.session import work_folder
from fleetloom.sources.segments import segment_lines, segment_stream
from fleetloom.streaming import keyed, known, minutes


def query(name, sql):
    """Register a stream query; on a local session its state is kept in as many parts as there are cores."""

    def add(fn):
        @wraps(fn)
        def sized(spark, d):
            key = "spark.sql.shuffle.partitions"
            before = spark.conf.get(key)
            if spark.sparkContext.master.startswith("local"):
                spark.conf.set(key, min(int(before), spark.sparkContext.defaultParallelism))
            try:
                return fn(spark, d)
            finally:
                spark.conf.set(key, before)

        return registry.query(name, sql)(sized)

    return add


def event_stream(spark, d):
    return minutes.table_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema, 64)


def arrivals(spark, df, ts, label, parts=3):
    """Append ``df`` to a folder in time order, part by part; yields the folder after each part."""
    at = F.unix_timestamp(ts)
    low, high = df.agg(F.min(at), F.max(at)).first()
    width, path = (high - low) // parts + 1, work_folder(spark, label)
    for i in range(parts):
        df.filter(F.floor((at - low) / width) == i).write.mode("append").parquet(path)
        yield path


@query("stream_minute_counts", """
SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS slot_start, count(*) AS samples FROM events
WHERE epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) + 3600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 60000000 FROM events) GROUP BY 1, 2
""")
def stream_minute_counts(spark, d):
    """Closed one-hour slots of the event stream."""
    out, work = work_folder(spark, "slots"), work_folder(spark, "slots-checkpoint")
    minutes.run_to_folder(minutes.minute_slots(event_stream(spark, d), "ts", ["event_type"], "1 hour", "1 minute"), out, work)
    return spark.read.parquet(out).select("event_type", F.unix_timestamp("slot_start").alias("slot_start"), "samples")


CADENCES = {"1 second": 1, "1 minute": 60, "5 minutes": 300, "1 hour": 3_600, "1 day": 86_400}


def cadence_sql():
    """Slots of each cadence from those of the one before; one is closed when a finer one that begins after it is."""
    parts, names = ["w AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 60000000 AS m FROM events)"], list(CADENCES)
    for i, name in enumerate(names):
        size = CADENCES[name] * 1_000_000
        rows = "SELECT event_type, epoch_us(ts) AS us, 1 AS n FROM events" if i == 0 else f"SELECT event_type, e - 1 AS us, n FROM c{i - 1}"
        closed = "e <= (SELECT m FROM w)" if i == 0 else f"e < (SELECT max(e) FROM c{i - 1})"
        parts.append(f"c{i} AS (SELECT * FROM (SELECT event_type, us // {size} * {size} + {size} AS e, sum(n)::BIGINT AS n FROM ({rows}) GROUP BY 1, 2) WHERE {closed})")
    tops = [f"SELECT '{name}' AS cadence, event_type, e // 1000000 - {CADENCES[name]} AS slot_start, n AS samples FROM c{i}" for i, name in enumerate(names)]
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(tops)


@query("stream_cadences", cadence_sql())
def stream_cadences(spark, d):
    """Seconds, minutes, five minutes, hours and days of the event stream, from one scan of it."""
    found = minutes.run_cadences(event_stream(spark, d), "ts", ["event_type"], list(CADENCES), work_folder(spark, "cadences"))
    return found.select("cadence", "event_type", F.unix_timestamp("slot_start").alias("slot_start"), "samples")


@query("stream_chained_days", """
WITH w AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 60000000 AS m FROM events)
SELECT event_type, epoch_us(date_trunc('day', ts)) // 1000000 AS slot_start, count(*) AS samples FROM events
WHERE epoch_us(date_trunc('day', ts)) + 86400000000 <= (SELECT m FROM w) GROUP BY 1, 2
""")
def stream_chained_days(spark, d):
    """Days made of hours made of minutes, in one query."""
    out, work = work_folder(spark, "days"), work_folder(spark, "days-checkpoint")
    minutes.run_to_folder(minutes.chained_slots(event_stream(spark, d), "ts", ["event_type"], ["1 minute", "1 hour", "1 day"]), out, work)
    return spark.read.parquet(out).select("event_type", F.unix_timestamp("slot_start").alias("slot_start"), "samples")


@query("stream_dedup", "SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, d):
    """The events, each written twice; one of each comes out."""
    ev = table(spark, d, "events")
    twice, out, work = work_folder(spark, "twice"), work_folder(spark, "dedup"), work_folder(spark, "dedup-checkpoint")
    ev.unionByName(ev).write.parquet(twice)
    s = minutes.stream_dedup(minutes.file_stream(spark, twice, ev.schema), "ts", ["event_id"], "1 hour")
    minutes.run_to_folder(s.select("event_id", "user_id", "value"), out, work)
    return spark.read.parquet(out)


@query("stream_ingest", "SELECT event_type, count(*) AS row_count, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1")
def stream_ingest(spark, d):
    ev = table(spark, d, "events")
    out, work = work_folder(spark, "ingest"), work_folder(spark, "ingest-checkpoint")
    for source in arrivals(spark, ev, "ts", "segments"):
        rows = minutes.incremental_source(spark, source, ev.schema, "part-00000")
        minutes.run_batches(rows, minutes.stream_ingest(out), work)
    back = spark.read.option("basePath", out).parquet(out)
    return back.groupBy("event_type").agg(F.count("*").alias("row_count"), F.sum("event_id").alias("id_sum"))


@query("segment_feed", """
SELECT event_type, count(*) AS row_count, CAST(sum(event_id) AS BIGINT) AS id_sum,
  count(*) FILTER (WHERE event_id > (SELECT max(event_id) // 3 FROM events)) AS later_count FROM events GROUP BY 1
""")
def segment_feed(spark, d):
    """Events as a feed of text segments, followed over three starts of the stream, and from a stored (segment, position)."""
    ev = table(spark, d, "events").select("event_id", "event_type")
    third = ev.agg(F.max("event_id")).first()[0] // 3
    feed, out, work = (work_folder(spark, x) for x in ("feed", "feed-rows", "feed-checkpoint"))
    fields = F.from_json("value", "event_id long, event_type string").alias("e")
    part = F.when(F.col("event_id") <= third, 0).when(F.col("event_id") <= 2 * third, 1).otherwise(2)
    for i in range(3):
        arrived = ev.filter(part == i).repartitionByRange("event_id").sortWithinPartitions("event_id")
        arrived.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{feed}/arrival-{i}")
        minutes.run_batches(segment_stream(spark, feed).select(fields).select("e.*"), minutes.stream_ingest(out), work, closing=False)
    lines = segment_lines(spark, feed).select("segment", "position", fields)
    place = lines.filter(F.col("e.event_id") > third).sort("e.event_id", "segment", "position").first()
    later = segment_lines(spark, feed, place["segment"], place["position"]).select(fields).groupBy("e.event_type").agg(F.count("*").alias("later_count"))
    back = spark.read.option("basePath", out).parquet(out).groupBy("event_type").agg(F.count("*").alias("row_count"), F.sum("event_id").alias("id_sum"))
    joined = back.join(later.withColumnRenamed("event_type", "_type"), F.col("event_type").eqNullSafe(F.col("_type")), "left")
    return joined.select("event_type", "row_count", "id_sum", F.coalesce("later_count", F.lit(0)).alias("later_count"))


@query("running_state", """
SELECT user_id, event_type, epoch_us(max(ts)) // 1000000 AS last_run, arg_max(value > 10, (ts, value > 10)) AS is_done FROM events GROUP BY 1, 2
""")
def running_state(spark, d):
    """Last run and done flag of every (user, event type), kept in the state store over three starts of the stream."""
    ev = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", (F.col("value") > 10).alias("is_done"))
    work = work_folder(spark, "state-checkpoint")
    for source in arrivals(spark, ev, "ts", "beats"):
        known.run_last_known(minutes.file_stream(spark, source, ev.schema), ["user_id", "event_type"], "ts", ["is_done"], work)
    return known.known_now(spark, work).select("user_id", "event_type", F.expr("last_us div 1000000").alias("last_run"), "is_done")


@query("running_state_orders", """
SELECT o_custkey, epoch_us(max(o_orderdate))::BIGINT // 1000000 AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS status,
  arg_max(total, (o_orderdate, total)) FILTER (WHERE total IS NOT NULL) AS last_large
FROM (SELECT *, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS total FROM orders) GROUP BY 1
""")
def running_state_orders(spark, d):
    """Newest order, its status and the last large amount of every customer; the orders come twice and in no order of time."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("last_large"))
    source, work = work_folder(spark, "orders"), work_folder(spark, "orders-checkpoint")
    turn = F.pmod(F.xxhash64("o_custkey", "o_orderdate"), F.lit(3))
    for i in range(2):
        rows.filter((turn == i) | (turn == 2)).write.mode("append").parquet(source)
        known.run_last_known(minutes.file_stream(spark, source, rows.schema), ["o_custkey"], "o_orderdate", ["status", "last_large"], work)
    return known.known_now(spark, work).select("o_custkey", F.expr("last_us div 1000000").alias("last_order"), "status", "last_large")


def rate_alarms(spark, d, sources, late_seconds=0):
    """The alarm path over hourly samples that arrive part by part."""
    samples = hourly(spark, d)
    out, work = work_folder(spark, "alarms"), work_folder(spark, "alarms-checkpoint")
    limit = F.when(F.col("event_type") == "error", 500.0).otherwise(1000.0)

    def limits(session):
        return table(session, d, "events").select("event_type").distinct().withColumn("threshold", limit)

    each = minutes.alarm_batches(
        out, limits, keys=["event_type"], slot="slot", counter="bytes", threshold="threshold", step_seconds=3600, alarm_id="110", end=F.col("slot")
    )
    for source in sources(samples):
        rates = minutes.stream_rates(
            minutes.file_stream(spark, source, samples.schema), keys=["event_type"], slot="slot", written="written", counters=["bytes"],
            step_seconds=3600, late_seconds=late_seconds,
        )
        minutes.run_batches(rates, each, work, closing=False)
    epoch = lambda c: F.unix_timestamp(F.col(c)).alias(c)
    return spark.read.option("basePath", out).parquet(out).select(
        "event_type", epoch("slot"), "bytes_rate", "threshold", "alarm_id", "content", epoch("range_begin"), epoch("range_end")
    )


@query("stream_rate_alarm", ALARMS)
def stream_rate_alarm(spark, d):
    """The alarm path batch by batch; the same alarms as the whole table gives at once."""
    return rate_alarms(spark, d, lambda samples: arrivals(spark, samples, "slot", "samples"))


@query("stream_rate_alarm_late", ALARMS)
def stream_rate_alarm_late(spark, d):
    """The same alarms when samples arrive in any order, a third of them twice, and none is lost or raised again."""

    def mixed(samples):
        source = work_folder(spark, "mixed")
        turn = F.pmod(F.xxhash64("event_type", "slot"), F.lit(3))
        for i in range(3):
            samples.filter((turn == i) | (turn == (i + 1) % 3) & (F.pmod(F.xxhash64("slot"), F.lit(3)) == 0)).write.mode("append").parquet(source)
            yield source

    return rate_alarms(spark, d, mixed, late_seconds=10 * 366 * 86_400)


@query("stream_converge", """
WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
nxt AS (SELECT a.user_id, a.us, min(b.us) AS us_next FROM e a JOIN e b ON a.user_id = b.user_id AND b.us >= a.us + 86400000000
        GROUP BY 1, 2),
walk AS (SELECT user_id, min(us) AS us FROM e GROUP BY 1
         UNION ALL SELECT w.user_id, n.us_next FROM walk w JOIN nxt n ON w.user_id = n.user_id AND w.us = n.us)
SELECT user_id, us AS sent_us FROM walk
""")
def stream_converge(spark, d):
    ev = table(spark, d, "events").filter(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    out, work = work_folder(spark, "sent"), work_folder(spark, "sent-checkpoint")
    for source in arrivals(spark, ev, "ts", "errors"):
        s = keyed.stream_converge(minutes.file_stream(spark, source, ev.schema), ["user_id"], "ts", 86_400, "1 hour")
        minutes.run_to_folder(s, out, work)
    return spark.read.parquet(out)


@query("stream_gap", """
WITH n AS (SELECT user_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS nxt,
                  (SELECT epoch_us(max(ts)) FROM events) - 60000000 - 86400000000 AS mark FROM events)
SELECT user_id, us AS silent_since_us FROM n WHERE (nxt IS NOT NULL AND nxt - us > 86400000000) OR (nxt IS NULL AND us // 1000 + 1 <= mark // 1000)
""")
def stream_gap(spark, d):
    """Users silent for more than a day, by a later report or by the watermark."""
    ev = table(spark, d, "events").select("event_id", "user_id", "ts")
    out, work = work_folder(spark, "silent"), work_folder(spark, "silent-checkpoint")
    for source in arrivals(spark, ev, "ts", "reports"):
        s = keyed.stream_gap(minutes.file_stream(spark, source, ev.schema), ["user_id"], "ts", 86_400, "1 minute")
        minutes.run_to_folder(s, out, work)
    return spark.read.parquet(out)
