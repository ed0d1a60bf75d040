"""Missing samples: markers, islands of missing slots, filled series, late reporters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions.skew import carry_values, previous_sample


def _epoch(c: Column) -> Column:
    return F.unix_timestamp(c)


def _slots(df: DataFrame, first: Column, last: Column, step: int, out: str, slice_steps: int = 10_000) -> DataFrame:
    """One row per slot from first to last, in two steps so that no row holds one long array."""
    length = step * slice_steps
    blocks = df.withColumns({"_first": first, "_last": last}).filter(F.col("_last") >= F.col("_first")).withColumn(
        "_block", F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(length)))
    )
    # A long gap is many blocks: they are dealt out before each becomes many rows.
    blocks = blocks.repartition(*[c for c in blocks.columns if c != "_first"])
    end = F.least(F.col("_block") + F.lit(length - step), F.col("_last"))
    return blocks.withColumn(out, F.explode(F.sequence(F.col("_block"), end, F.lit(step)))).drop("_first", "_last", "_block")


def observed_slots(samples: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    return samples.select(*keys, slot).distinct()


def gap_islands(samples: DataFrame, keys: Sequence[str], slot: str, step_seconds: int, min_slots: int = 1, bounds: tuple | None = None,
                expected: DataFrame | None = None) -> DataFrame:
    """Runs of missing slots per key: ``gap_start``, ``gap_end`` (epoch seconds) and ``missing``.

    A gap is read off two neighbouring samples, so the grid of keys x slots is never built. Without ``bounds`` a key
    is expected between its own first and last sample; with ``bounds`` (two epoch seconds) for the whole range, and a
    key of the ``expected`` table that has no sample at all is one gap over the range.
    """
    seen = observed_slots(samples, keys, slot)
    near = previous_sample(seen, keys, slot, [])
    between = near.filter(F.col(f"prev_{slot}").isNotNull()).select(
        *keys, (_epoch(F.col(f"prev_{slot}")) + step_seconds).alias("gap_start"), (_epoch(F.col(slot)) - step_seconds).alias("gap_end"),
    )
    if bounds is not None:
        ends = samples.groupBy(*keys).agg(F.min(_epoch(F.col(slot))).alias("_lo"), F.max(_epoch(F.col(slot))).alias("_hi"))
        if expected is not None:
            # A key without samples: the gap before its first sample reaches to the end of the range.
            ends = expected.select(*keys).join(ends, list(keys), "left").withColumns({
                "_lo": F.coalesce("_lo", F.lit(bounds[1] + step_seconds)), "_hi": F.coalesce("_hi", F.lit(bounds[1])),
            })
        edge = F.array(
            F.struct(F.lit(bounds[0]).cast("long").alias("gap_start"), (F.col("_lo") - step_seconds).alias("gap_end")),
            F.struct((F.col("_hi") + step_seconds).alias("gap_start"), F.lit(bounds[1]).cast("long").alias("gap_end")),
        )
        between = between.unionByName(ends.select(*keys, F.explode(edge).alias("_e")).select(*keys, "_e.*"))
        # Samples outside the range must not move its ends: every gap is cut to the slots inside.
        first, last = F.lit(bounds[0]).cast("long"), F.lit(bounds[1]).cast("long")
        late = F.greatest(F.col("gap_start"), F.col("gap_start") + F.ceil((first - F.col("gap_start")) / step_seconds) * step_seconds)
        early = F.least(F.col("gap_end"), F.col("gap_end") - F.ceil((F.col("gap_end") - last) / step_seconds) * step_seconds)
        between = between.withColumns({"gap_start": late.cast("long"), "gap_end": early.cast("long")})
    missing = ((F.col("gap_end") - F.col("gap_start")) / step_seconds).cast("long") + 1
    return between.filter(F.col("gap_end") >= F.col("gap_start")).withColumn("missing", missing).filter(
        F.col("missing") >= min_slots
    )


def gap_markers(samples: DataFrame, keys: Sequence[str], slot: str, step_seconds: int, bounds: tuple | None = None,
                expected: DataFrame | None = None) -> DataFrame:
    """One marker row per expected (key, slot) without a sample; ``slot_epoch`` in seconds."""
    islands = gap_islands(samples, keys, slot, step_seconds, 1, bounds, expected)
    return _slots(islands, F.col("gap_start"), F.col("gap_end"), step_seconds, "slot_epoch").select(*keys, "slot_epoch")


def fill_gaps(samples: DataFrame, keys: Sequence[str], slot: str, values: Sequence[str], step_seconds: int) -> DataFrame:
    """The series with every missing slot, and every NULL value, filled from what was last known; ``filled`` tells where.

    ``(keys, slot)`` must be unique. What comes before the first known value stays NULL.
    """
    known = carry_values(samples.select(*keys, slot, *values), keys, slot, values).withColumn("_own", _epoch(F.col(slot)))
    # Each sample stands for itself and for the missing slots before it.
    first = F.coalesce(_epoch(F.col("before_slot")) + step_seconds, F.col("_own"))
    series = _slots(known, F.least(first, F.col("_own")), F.col("_own"), step_seconds, "slot_epoch")
    real = F.col("slot_epoch") == F.col("_own")
    complete = reduce(and_, [F.col(v).isNotNull() for v in values])
    return series.select(
        *keys, "slot_epoch", *[F.coalesce(F.when(real, F.col(v)), F.col(f"before_{v}")).alias(v) for v in values],
        (~(real & complete)).alias("filled"),
    )


def overdue(
    events: DataFrame, keys: Sequence[str], ts: str, now: Column, every_seconds: Column | int, expected: DataFrame | None = None
) -> DataFrame:
    """Reporters whose last time is not within ``every_seconds`` before ``now``.

    With a table of ``expected`` keys the ones that never reported are overdue too; their ``last_seen`` is NULL.
    """
    last = events.groupBy(*keys).agg(F.max(ts).alias("last_seen"))
    if expected is not None:
        last = expected.select(*keys).join(last, list(keys), "left")
    late = _epoch(now) - _epoch(F.col("last_seen"))
    return last.withColumn("late_seconds", late).filter(F.col("last_seen").isNull() | (F.col("late_seconds") >= every_seconds))


def capacity_trend(snapshots: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str], last_day: Column, days: int = 30) -> DataFrame:
    """Per key and day the measures and their growth since the day before in the range.

    Rows of one key and day are summed first, so a key's window has at most ``days`` rows.
    """
    inside = snapshots.filter((F.col(day) <= last_day) & (F.col(day) > F.date_sub(last_day, days)))
    daily = inside.groupBy(*keys, day).agg(*[F.sum(m).alias(m) for m in measures])
    w = Window.partitionBy(*keys).orderBy(day)
    return daily.withColumns({f"{m}_growth": F.col(m) - F.lag(m).over(w) for m in measures})
