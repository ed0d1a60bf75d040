"""Slot aggregates, deduplication and rate alarms over a stream of samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fleetloom.operators.config import threshold_join
from fleetloom.operators.rates import paired_rates


def file_stream(spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_batch: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Follow a folder of append-only files. The checkpoint of the query remembers which were taken."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Follow a table that may be one file or a folder of part files."""
    # A pattern that only the path itself fits: Spark wants a folder where a plain path is given.
    return file_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, None, files_per_batch)


def incremental_source(
    spark: SparkSession, path: str, schema, first_segment: str | None = None, files_per_batch: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Append-only segment files from ``first_segment`` on, each with its ``segment`` name."""
    rows = file_stream(spark, path, schema, None, files_per_batch, fmt).withColumn("segment", F.col("_metadata.file_name"))
    return rows.filter(F.col("segment") >= first_segment) if first_segment else rows


def minute_slots(stream: DataFrame, ts: str, keys: Sequence[str], slot: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Counts per key and fixed slot; a slot is closed once the newest sample is ``late`` past its end."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", slot).alias("_w"), *keys).agg(F.count("*").alias("samples")).select(
        *keys, F.col("_w.start").alias("slot_start"), F.col("_w.end").alias("slot_end"), "samples"
    )


def chained_slots(stream: DataFrame, ts: str, keys: Sequence[str], cadences: Sequence[str], late: str = "1 minute") -> DataFrame:
    """Counts per key and slot of the last cadence, each made of the slots of the one before it, in one append query.

    A late sample is kept or dropped where the first slots are counted, so every cadence agrees on it.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    slots = timed.groupBy(F.window("_ts", cadences[0]).alias("_w"), *keys).agg(F.count("*").alias("samples"))
    for cadence in cadences[1:]:
        slots = slots.groupBy(F.window(F.window_time("_w"), cadence).alias("_w"), *keys).agg(F.sum("samples").alias("samples"))
    return slots.select(*keys, F.col("_w.start").alias("slot_start"), F.col("_w.end").alias("slot_end"), "samples")


def run_cadences(stream: DataFrame, ts: str, keys: Sequence[str], cadences: Sequence[str], path: str, late: str = "1 minute") -> DataFrame:
    """All cadences from one scan of the stream: (cadence, keys, slot_start, slot_end, samples) of the slots closed so far.

    The first cadence is counted from the samples and written; each further one follows the closed slots of the one before it,
    as a stream of its own, so it reads and holds slots only. Closed slots come in order of time, so none is late there; a slot
    is closed once one of the finer cadence that begins after it is. Takes all that is there and stops; the next call goes on.
    """
    spark, keys, folders = stream.sparkSession, list(keys), []
    for i, cadence in enumerate(cadences):
        folder = f"{path}/cadence-{i}"
        if i:
            finer = file_stream(spark, folders[-1], spark.read.parquet(folders[-1]).schema)
            timed = finer.withColumn("_ts", F.expr("slot_end - INTERVAL 1 MICROSECOND")).withWatermark("_ts", "0 seconds")
            slots = timed.groupBy(F.window("_ts", cadence).alias("_w"), *keys).agg(F.sum("samples").alias("samples")).select(
                *keys, F.col("_w.start").alias("slot_start"), F.col("_w.end").alias("slot_end"), "samples"
            )
        else:
            slots = minute_slots(stream, ts, keys, cadence, late)
        run_to_folder(slots, folder, f"{path}/checkpoint-{i}")
        folders.append(folder)
    found = [spark.read.parquet(f).select(F.lit(c).alias("cadence"), *keys, "slot_start", "slot_end", "samples") for c, f in zip(cadences, folders)]
    return reduce(DataFrame.unionByName, found)


def stream_dedup(stream: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    """One row per key: a replay that arrives within ``late`` is dropped."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(
        list(keys)
    ).drop("_ts")


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take all that is there now into parquet files and stop; a second run goes on from the checkpoint."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", closing: bool = True
) -> StreamingQuery:
    """Hand all that is there now to ``each``, batch by batch, and stop; returns the ended query for its progress.

    ``closing`` adds a batch without rows that closes what the newest rows have passed. A stream that closes nothing, such
    as a join, does without it: the next rows make it forget.
    """
    spark, key = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, str(closing).lower())
    try:
        query: StreamingQuery = (
            stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return query


def stream_ingest(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that gives every batch its own folder, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def stream_rates(
    stream: DataFrame, *, keys: Sequence[str], slot: str, written: str, counters: Sequence[str], step_seconds: int, late_seconds: int = 0, **options
) -> DataFrame:
    """Rates of the counters of a stream of samples, as ``counter_rate`` gives them for a table.

    The stream is joined with itself: a sample meets the one a step earlier, whichever of them comes first. Samples may arrive
    up to ``late_seconds`` and a step behind the newest one, in any order and more than once: the first of a (key, slot) counts,
    later ones than that are dropped. The join goes by key **and** slot, so one busy key is many groups, and both sides forget a
    sample once the watermark has passed its partner's time.
    """
    keys, carry = list(keys), [written, *counters]
    at = F.unix_timestamp(F.col(slot))
    wait = f"{late_seconds + step_seconds} seconds"
    timed = stream.select(*keys, slot, *carry, at.alias("_at"), F.col(slot).cast("timestamp").alias("_ts")).filter(F.col("_ts").isNotNull())
    once = timed.withWatermark("_ts", wait).dropDuplicatesWithinWatermark([*keys, slot])
    before = once.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys], (F.col("_at") + step_seconds).alias("_due"), F.col("_ts").alias("_before"),
        *[F.col(c).alias(f"before_{c}") for c in carry],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    # The range says the same as the equality, to the second, in the form from which Spark knows how long to keep a row.
    near = F.expr(f"_ts BETWEEN _before + INTERVAL {step_seconds - 1} SECONDS AND _before + INTERVAL {step_seconds + 1} SECONDS")
    met = once.join(before, reduce(and_, [*same, F.col("_at") == F.col("_due"), near]))
    return paired_rates(met, keys, slot, written, counters, **options)


def alarm_batches(
    out_path: str, thresholds: Callable[[SparkSession], DataFrame], *, keys: Sequence[str], slot: str, counter: str, threshold: str,
    step_seconds: int, alarm_id: str, end: Column,
) -> Callable[[DataFrame, int], None]:
    """Batch writer that turns rates into alarms with the thresholds of the moment.

    ``thresholds`` is called for each batch, so changed configuration is taken up without a restart. A batch has a folder of
    its own, so repeating one replaces it; as a rate comes once, so does its alarm.
    """

    def each(batch: DataFrame, number: int) -> None:
        begin = F.col(slot) - F.expr(f"INTERVAL {int(step_seconds)} SECONDS")
        threshold_join(
            batch, thresholds(batch.sparkSession), list(keys), f"{counter}_rate", threshold, alarm_id=alarm_id, spread=[*keys, slot], begin=begin, end=end
        ).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return each
