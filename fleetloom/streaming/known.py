"""Last known values by key, held in the state store of a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fleetloom.session import ship_package
from fleetloom.streaming.minutes import run_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "last"


@contextmanager
def rocks(spark: SparkSession):
    """State that lives on the executors' disks with its changes written to the checkpoint, so that it may outgrow memory."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _newer(state: list, row: tuple) -> list:
    """State after one report: the newest time, and for every value the newest one that was given (the larger one of equals)."""
    at = row[0]
    out = [at if state[0] is None else max(at, state[0])]
    for i in range(1, len(row)):
        value, when = state[2 * i - 1], state[2 * i]
        if row[i] is not None and (when is None or (at, row[i]) > (when, value)):
            value, when = row[i], at
        out += [value, when]
    return out


class _Last(StatefulProcessor):
    def __init__(self, fields: list[T.StructField], keys: list[str], values: list[str], forget_ms: int):
        self.keys, self.values, self.forget_ms = keys, values, forget_ms
        self.kinds = T.StructType(fields)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(STATE, self.kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        now = [None] * len(self.kinds) if before is None else [None if pd.isna(v) else v for v in before]
        for pdf in rows:
            for row in pdf[["at_us", *self.values]].astype(object).itertuples(index=False, name=None):
                now = _newer(now, tuple(None if pd.isna(v) else v for v in row))
        self.state.update(tuple(now))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(now[0] // 1_000 + self.forget_ms, timerValues.getCurrentWatermarkInMs() + 1))
        names = [f.name for f in self.kinds]
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, **{n: pd.Series([v], dtype=object) for n, v in zip(names, now)}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def last_known(stream: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], late: str = "0 seconds", forget_seconds: int | None = None) -> DataFrame:
    """Changed keys of every batch: keys, ``last_us``, and ``<value>``, ``<value>_us`` for each value.

    A key keeps the time of its newest report, and of every value the newest one that was not NULL, with its time. Reports may
    come in any order and more than once: what is kept is the same. A batch reads and writes the state of its own keys
    only. Reports without a time are dropped. With ``forget_seconds`` a key is forgotten once the watermark (``late`` behind the
    newest report) has passed its last report by that long.

    What is kept are maxima, so Spark's own streaming aggregate keeps them. Only forgetting needs timers by key, and with
    it a call into Python for every key of a batch.
    """
    keys, values = list(keys), list(values)
    if forget_seconds is None:
        at = F.col(ts).cast("timestamp")
        given = stream.filter(at.isNotNull()).select(*keys, F.unix_micros(at).alias("at_us"), *values)
        # The names inside of the structs are what `known_now` finds in the state.
        newest = [F.max(F.when(F.col(v).isNotNull(), F.struct("at_us", v))).alias(v) for v in values]
        kept = given.groupBy(*keys).agg(F.max("at_us").alias("last_us"), *newest)
        return kept.select(*keys, "last_us", *[x for v in values for x in (F.col(v)[v].alias(v), F.col(v)["at_us"].alias(f"{v}_us"))])
    ship_package(stream.sparkSession)
    kinds = [stream.schema[v] for v in values]
    fields = [T.StructField("last_us", T.LongType())]
    for v, f in zip(values, kinds):
        fields += [T.StructField(v, f.dataType), T.StructField(f"{v}_us", T.LongType())]
    timed = stream.select(*keys, F.col(ts).cast("timestamp").alias("_ts"), *values).filter(F.col("_ts").isNotNull())
    rows = timed.withWatermark("_ts", late).withColumn("at_us", F.unix_micros("_ts"))
    return rows.groupBy(*keys).transformWithStateInPandas(
        _Last(fields, keys, values, forget_seconds * 1_000), T.StructType([*[stream.schema[k] for k in keys], *fields]), "Update", "EventTime",
    )


def run_last_known(stream: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], checkpoint: str, changes: str | None = None, **options) -> StreamingQuery:
    """Take all that is there into the state at ``checkpoint`` and stop; the changed keys of a batch go to ``changes``/batch=n.

    A repeated batch starts from the state before it and replaces its own folder, so it changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        target = batch.write.mode("overwrite")
        target.parquet(f"{changes}/batch={number}") if changes else target.format("noop").save()

    with rocks(stream.sparkSession):
        return run_batches(last_known(stream, keys, ts, values, **options), each, checkpoint, "update")


def known_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of all keys as the last batch left it, read from the state store: the columns of ``last_known``."""
    with rocks(spark):
        operator = spark.read.format("state-metadata").load(checkpoint).first()["operatorName"]
        state = spark.read.format("statestore")
        if operator != "stateStoreSave":
            return state.option("stateVarName", STATE).load(checkpoint).select("key.*", "value.*")
        kept = state.load(checkpoint)
        # The newest time, and for each value a struct of its time and itself, in the order of the aggregate. The places have the
        # names of Spark's buffers, which repeat, so they are named anew.
        newest = [f.dataType for f in kept.schema["value"].dataType.fields[1:]]
        names = [t.names[1] for t in newest]
        named = T.StructType([T.StructField("last_us", T.LongType()), *[T.StructField(v, t) for v, t in zip(names, newest)]])
        kept = kept.select("key.*", F.col("value").cast(named).alias("value"))
        parts = [x for v in names for x in (F.col("value")[v][v].alias(v), F.col("value")[v]["at_us"].alias(f"{v}_us"))]
        return kept.select(*kept.columns[:-1], "value.last_us", *parts)
