"""Stateful forms by key: alarm convergence and reporting gaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetloom.operators.alarms import NEVER, sent_times
from fleetloom.session import ship_package


def _timed(stream: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    ship_package(stream.sparkSession)
    timed = stream.select(*keys, F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", late)
    return timed.withColumn("_us", F.unix_micros("_ts"))


def stream_converge(stream: DataFrame, keys: Sequence[str], ts: str, hold_seconds: int, late: str) -> DataFrame:
    """Alarms sent when each key stays silent for ``hold_seconds`` after a message: keys and ``sent_us``.

    The state of a key is one number, the time it may send again. Input order across batches is taken as it comes.
    """
    hold = hold_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        allowed = state.get[0] if state.exists else NEVER
        times = np.unique(np.concatenate([b["_us"].to_numpy() for b in batches]))
        sent = sent_times(times, hold, allowed)
        if len(sent):
            allowed = int(sent[-1]) + hold
        state.update((allowed,))
        # A state that can no longer hold anything back is dropped.
        state.setTimeoutTimestamp(max(allowed // 1_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{k: [v] * len(sent) for k, v in zip(keys, key)}, "sent_us": sent})

    fields = [stream.schema[k] for k in keys]
    return _timed(stream, keys, ts, late).groupBy(*keys).applyInPandasWithState(
        step, T.StructType([*fields, T.StructField("sent_us", T.LongType())]), T.StructType([T.StructField("allowed", T.LongType())]),
        "append", GroupStateTimeout.EventTimeTimeout,
    )


def stream_gap(stream: DataFrame, keys: Sequence[str], ts: str, limit_seconds: int, late: str) -> DataFrame:
    """One alarm for every time a key has not reported for more than ``limit_seconds``: keys and ``silent_since_us``.

    Raised by the next report when that comes too late, or by the watermark when none comes.
    """
    limit = limit_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, False)
        if state.hasTimedOut:
            state.update((last, True))
            found = [] if told else [last]
        else:
            times = np.unique(np.concatenate([b["_us"].to_numpy() for b in batches]))
            series = times if last is None else np.unique(np.append(times, last))
            since = series[:-1][np.diff(series) > limit]
            found = [int(s) for s in since if not (told and s == last)]
            newest = int(series[-1])
            told = told and newest == last
            state.update((newest, told))
            if not told:
                # One millisecond past the limit: at the limit itself the key is not late yet.
                due = (newest + limit) // 1_000 + 1
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({**{k: [v] * len(found) for k, v in zip(keys, key)}, "silent_since_us": found})

    fields = [stream.schema[k] for k in keys]
    return _timed(stream, keys, ts, late).groupBy(*keys).applyInPandasWithState(
        step, T.StructType([*fields, T.StructField("silent_since_us", T.LongType())]),
        T.StructType([T.StructField("last", T.LongType()), T.StructField("told", T.BooleanType())]),
        "append", GroupStateTimeout.EventTimeTimeout,
    )
