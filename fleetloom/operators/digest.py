"""Statement digests and sampled capture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.skew import top_n_per_group
from fleetloom.operators.tables import derive_and_require


def fingerprint(text: Column) -> Column:
    """Lower case, quoted text and digit runs replaced by ``?``, white space squeezed. The rules are our own."""
    # '...' or a run of digits; begun with a character class, which is searched for faster than an alternative.
    t = F.regexp_replace(F.lower(text), "['0-9](?:(?<=[0-9])[0-9]*|(?<=')[^']*')", "?")
    return F.trim(F.regexp_replace(t, "[ \\t\\r\\n]+", " "))


def digest_rollup(
    rows: DataFrame, text: str, ts: str, metric: str, source: Sequence[str], slot_seconds: int, percentile: float = 0.95, accuracy: int = 10_000
) -> DataFrame:
    """History: one row per fingerprint, source and time slot, all of them kept. Rows with empty text are dropped.

    Every aggregate combines map-side, so one statement behind most of the traffic costs no more than another.
    """
    slot = F.floor(F.unix_timestamp(F.col(ts)) / slot_seconds).cast("long") * slot_seconds
    named = derive_and_require(rows, {"fingerprint": fingerprint(F.col(text)), "slot_epoch": slot}, F.col(text))
    m = F.col(metric)
    return named.groupBy("fingerprint", *source, "slot_epoch").agg(
        F.count("*").alias("calls"), F.sum(m).alias("metric_sum"), F.min(m).alias("metric_min"), F.max(m).alias("metric_max"),
        F.percentile_approx(m, percentile, accuracy).alias("metric_pct"), F.sum(F.octet_length(text)).alias("bytes"),
        F.min(F.unix_timestamp(F.col(ts))).alias("first_seen"), F.max(F.unix_timestamp(F.col(ts))).alias("last_seen"),
    )


def digest_history(
    rows: DataFrame, text: str, ts: str, metric: str, source: Sequence[str], slot_seconds: int, who: str | None = None, rank_k: int = 800, log_registers: int = 12
) -> DataFrame:
    """History that can be merged: ``digest_rollup`` with sketches in place of a percentile.

    ``metric_kll`` holds the distribution of the metric; with ``rank_k`` 800 a rank read from it is off by less than half a
    percent, and up to that many values are kept exactly. ``who_hll`` counts the different ``who`` to about 1.6 %. A row with its
    sketches is some KB, whatever it stands for. NULL metrics and users are not counted in the sketches.
    """
    slot = F.floor(F.unix_timestamp(F.col(ts)) / slot_seconds).cast("long") * slot_seconds
    named = derive_and_require(rows, {"fingerprint": fingerprint(F.col(text)), "slot_epoch": slot}, F.col(text))
    m, at = F.col(metric), F.unix_timestamp(F.col(ts))
    found = [
        F.count("*").alias("calls"), F.sum(m).alias("metric_sum"), F.min(m).alias("metric_min"), F.max(m).alias("metric_max"),
        F.sum(F.octet_length(text)).alias("bytes"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"),
        F.kll_sketch_agg_double(m.cast("double"), rank_k).alias("metric_kll"),
    ]
    if who:
        found.append(F.hll_sketch_agg(F.col(who).cast("string"), log_registers).alias("who_hll"))
    return named.groupBy("fingerprint", *source, "slot_epoch").agg(*found)


def digest_merge(history: DataFrame, source: Sequence[str], slot_seconds: int | None = None) -> DataFrame:
    """Coarser history from finer, without the statements: slots of ``slot_seconds``, or one row for all time.

    ``source`` may name fewer columns than the history has. Merging is associative: hours to days and days to months give what
    hours to months give, up to the error of the sketches.
    """
    by = ["fingerprint", *source]
    rows = history
    if slot_seconds:
        rows = rows.withColumn("slot_epoch", F.floor(F.col("slot_epoch") / slot_seconds).cast("long") * slot_seconds)
        by.append("slot_epoch")
    found = [
        F.sum("calls").alias("calls"), F.sum("metric_sum").alias("metric_sum"), F.min("metric_min").alias("metric_min"), F.max("metric_max").alias("metric_max"),
        F.sum("bytes").alias("bytes"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.kll_merge_agg_double("metric_kll").alias("metric_kll"),
    ]
    if "who_hll" in history.columns:
        found.append(F.hll_union_agg("who_hll").alias("who_hll"))
    return rows.groupBy(*by).agg(*found)


def digest_read(history: DataFrame, percentile: float = 0.95) -> DataFrame:
    """History with its sketches read: ``metric_pct``, NULL where no metric was given, and ``who_count``."""
    filled = F.kll_sketch_get_n_double("metric_kll") > 0
    out = history.withColumn("metric_pct", F.when(filled, F.kll_sketch_get_quantile_double("metric_kll", F.lit(float(percentile))))).drop("metric_kll")
    return out.withColumn("who_count", F.hll_sketch_estimate("who_hll")).drop("who_hll") if "who_hll" in history.columns else out


def digest_review(history: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """One row per fingerprint with first and last seen, merged into an existing review table."""
    seen = history.groupBy("fingerprint").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    if review is None:
        return seen
    return review.select("fingerprint", "first_seen", "last_seen").unionByName(seen).groupBy("fingerprint").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def periodic_capture(rows: DataFrame, source: Sequence[str], ts: str, ties: Sequence[str], on_seconds: int, off_seconds: int, max_rows: int) -> DataFrame:
    """Sample in time: the first ``on_seconds`` of every cycle, at most ``max_rows`` per source and cycle."""
    cycle = on_seconds + off_seconds
    at = F.unix_timestamp(F.col(ts))
    inside = rows.withColumn("cycle", F.floor(at / cycle).cast("long")).filter(F.pmod(at, F.lit(cycle)) < on_seconds)
    return top_n_per_group(inside, [*source, "cycle"], [F.col(ts), *[F.col(t) for t in ties]], max_rows, [ts, *ties])
