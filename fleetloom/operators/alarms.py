"""Alarm convergence: fewer messages for repeated alarms of a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.functions.skew import mark_hot, ordinal_in_key
from fleetloom.session import pin, ship_package

# A time before all others: nothing holds back the first alarm.
NEVER = int(np.iinfo(np.int64).min)


def converge_time(alarms: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], slot_seconds: int) -> DataFrame:
    """First alarm of every key in every fixed time slot, with the number it stands for."""
    slot = F.floor(F.unix_timestamp(F.col(ts)) / slot_seconds).cast("long") * slot_seconds
    first = F.min_by(F.struct(F.col(ts), *[F.col(t) for t in ties]), F.struct(F.col(ts), *[F.col(t) for t in ties]))
    return alarms.withColumn("slot_epoch", slot).groupBy(*keys, "slot_epoch").agg(
        first.alias("_first"), F.count("*").alias("alarms")
    ).select(*keys, "slot_epoch", "_first.*", "alarms")


def converge_count(alarms: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], every: int, slice_seconds: int = 60) -> DataFrame:
    """Alarms 1, 1 + n, 1 + 2n of every key."""
    numbered = ordinal_in_key(alarms, keys, ts, ties, slice_seconds)
    return numbered.filter((F.col("ordinal") - 1) % every == 0)


def sent_times(times: np.ndarray, hold: int, allowed: int) -> np.ndarray:
    """Alarms sent when nothing may be sent before ``allowed`` and then once per ``hold``. ``times`` is sorted."""
    following = np.searchsorted(times, times + hold).tolist()
    picked, i = [], int(np.searchsorted(times, allowed))
    while i < len(following):
        picked.append(i)
        i = following[i]
    return times[picked]


def slice_exits(times: np.ndarray, begin: int, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """Which last sent alarm follows from each possible first sent one of a slice that starts at ``begin``.

    Only the first ``hold`` of a slice can be blocked from before, so only its alarms, and one more for a slice that
    opens quietly, are possible starts. Starts with the same end are merged: the latest start that leads there.
    """
    ends = times[:int(np.searchsorted(times, begin + hold)) + 1]
    starts = ends
    # All starts advance together, one message per round.
    while True:
        at = np.searchsorted(times, ends + hold)
        more = at < len(times)
        if not more.any():
            break
        ends = np.where(more, times[np.minimum(at, len(times) - 1)], ends)
    last_of_run = np.append(ends[1:] != ends[:-1], True)
    return starts[last_of_run], ends[last_of_run]


def allowed_after(thresholds: np.ndarray, exits: np.ndarray, allowed):
    """Time an alarm may be sent again after a stretch of time: the exit of the first threshold that is not before ``allowed``.

    A stretch in which nothing can be sent any more leaves ``allowed`` as it is.
    """
    at = np.searchsorted(thresholds, allowed)
    return np.where(at < len(exits), np.append(exits, 0)[at], allowed)


def joined_steps(parts: list, hold: int, length: int) -> tuple[int, np.ndarray, np.ndarray]:
    """One stretch made of several in order: the number of its first slice, thresholds and exits.

    Such functions of 'may be sent from' compose, and composing is associative. Whoever comes from before may be held back
    into the first ``hold`` of the stretch only, so one threshold beyond that is enough, and thresholds with one exit are one:
    a stretch has no more steps than its first slice, and one.
    """
    first = int(parts[0]["_first"])
    limit = first * length + hold
    t, e = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p in parts:
        pt, pe = np.asarray(p["_t"], np.int64), np.asarray(p["_e"], np.int64)
        beyond = slice(int(np.searchsorted(pt, t[-1], "right")) if len(t) else 0, None)
        t, e = np.concatenate((t, pt[beyond])), np.concatenate((allowed_after(pt, pe, e), pe[beyond]))
        last_of_run = np.append(e[1:] != e[:-1], True)[: len(e)]
        t, e = t[last_of_run], e[last_of_run]
        enough = int(np.searchsorted(t, limit)) + 1
        t, e = t[:enough], e[:enough]
    return first, t, e


def _slice_entries(exits: DataFrame, keys: list[str], hold: int, length: int, fan: int) -> DataFrame:
    """(keys, _slice, _allowed): the state every slice is entered with.

    ``fan`` neighbouring slices are joined to one stretch, ``fan`` of those to the next, up to one for each key; then the states go
    down the same way. No group has more than ``fan`` rows, whatever the key.
    """
    key_fields = [exits.schema[k] for k in keys]
    longs = T.ArrayType(T.LongType())
    step_fields = [T.StructField("_slice", T.LongType()), T.StructField("_first", T.LongType()), T.StructField("_t", longs), T.StructField("_e", longs)]
    low, high = exits.agg(F.min("_slice"), F.max("_slice")).first()
    levels = [exits.withColumn("_slice", F.col("_slice") - F.lit(low or 0))]
    span = 1 if low is None else high - low + 1
    part = F.struct("_slice", "_first", "_t", "_e")
    above = F.expr(f"_slice div {fan}").alias("_slice")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [joined_steps(list(p), hold, length) for p in pdf["_parts"]]
            yield pdf[[*keys, "_slice"]].assign(_first=[f[0] for f in found], _t=[f[1] for f in found], _e=[f[2] for f in found])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for parts, allowed in zip(pdf["_parts"], pdf["_allowed"].tolist()):
                states = []
                for p in parts:
                    states.append((int(p["_slice"]), allowed))
                    allowed = int(allowed_after(np.asarray(p["_t"], np.int64), np.asarray(p["_e"], np.int64), allowed))
                rows.append(states)
            out = pdf[keys].assign(_s=rows).explode("_s", ignore_index=True)
            yield out[keys].assign(_slice=[x[0] for x in out["_s"]], _allowed=[x[1] for x in out["_s"]])

    while span > 1:
        groups = levels[-1].select(*keys, above, part.alias("_p")).groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list("_p")).alias("_parts"))
        levels.append(pin(groups.mapInPandas(join, T.StructType([*key_fields, *step_fields]))))
        span = -(-span // fan)
    entries = levels[-1].select(*keys, "_slice", F.lit(NEVER).alias("_allowed"))
    for level in reversed(levels[:-1]):
        # The state of a stretch joins its parts as one more row.
        parts = level.select(*keys, above, part.alias("_p")).unionByName(entries, allowMissingColumns=True)
        groups = parts.groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list("_p")).alias("_parts"), F.max("_allowed").alias("_allowed"))
        entries = groups.mapInPandas(walk, T.StructType([*key_fields, T.StructField("_slice", T.LongType()), T.StructField("_allowed", T.LongType())]))
    return entries.withColumn("_slice", F.col("_slice") + F.lit(low or 0))


def converge_exact(
    alarms: DataFrame, keys: Sequence[str], ts: str, hold_seconds: int, slice_seconds: int | None = None,
    hot_share: int = 100_000, hot_min_rows: int = 100_000, fan: int = 64,
) -> DataFrame:
    """Alarms sent when each key stays silent for ``hold_seconds`` after every message: keys and ``sent_us``.

    A decision depends on the one before. The alarms of an ordinary key are walked in one go. A key with more than
    ``hot_min_rows`` alarms and more than 1/``hot_share`` of all is cut into time slices of ``slice_seconds`` (16 holds
    unless given, never less than one), so that most starts of a slice lead to one end and merge: each slice is summarised
    as 'may be sent from -> may be sent from afterwards', the summaries are joined ``fan`` at a time in a tree, and every slice is
    then decided on its own from the state it is entered with. An alarm without a time is never sent.
    """
    ship_package(alarms.sparkSession)
    keys = list(keys)
    hold, length = hold_seconds * 1_000_000, max(16 * hold_seconds if slice_seconds is None else slice_seconds, hold_seconds) * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    # Alarms at the same moment decide the same way.
    moments = alarms.select(*keys, us.alias("_us")).filter(F.col("_us").isNotNull()).distinct()
    number = F.when(F.col("_hot"), F.floor(F.col("_us") / length)).cast("long")
    moments = mark_hot(moments, keys, hot_share, hot_min_rows).select(*keys, "_us", number.alias("_slice"))
    lists = moments.filter(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list("_us")).alias("_times"))
    key_fields = [alarms.schema[k] for k in keys]
    slice_field = T.StructField("_slice", T.LongType())
    longs = T.ArrayType(T.LongType())

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [slice_exits(np.asarray(t), int(n) * length, hold) for t, n in zip(pdf["_times"], pdf["_slice"])]
            yield pdf[[*keys, "_slice"]].assign(_first=pdf["_slice"], _t=[f[0] for f in found], _e=[f[1] + hold for f in found])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sent = [sent_times(np.asarray(t), hold, a) for t, a in zip(pdf["_times"], pdf["_allowed"].tolist())]
            owner = np.repeat(np.arange(len(pdf)), [len(x) for x in sent])
            yield pdf[keys].iloc[owner].assign(sent_us=np.concatenate([*sent, np.array([], dtype="int64")]))

    steps = T.StructType([*key_fields, slice_field, T.StructField("_first", T.LongType()), T.StructField("_t", longs), T.StructField("_e", longs)])
    entries = _slice_entries(pin(lists.mapInPandas(summarise, steps)), keys, hold, length, fan)
    # The state a slice is entered with joins its moments as one more row.
    decided = moments.unionByName(entries, allowMissingColumns=True).groupBy(*keys, "_slice").agg(
        F.array_sort(F.collect_list("_us")).alias("_times"), F.coalesce(F.max("_allowed"), F.lit(NEVER)).alias("_allowed")
    )
    return decided.mapInPandas(decide, T.StructType([*key_fields, T.StructField("sent_us", T.LongType())]))
