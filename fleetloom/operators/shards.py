"""Date-sharded tables: expected names, coverage, union, routing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions import scalars as S


def default_end(today: dt.date) -> dt.date:
    """Last day of next year."""
    return dt.date(today.year + 1, 12, 31)


def _days(start: Column, end: Column, template: str) -> Column:
    if "#mmdd#" in template:
        return F.sequence(start, end, F.expr("INTERVAL 1 DAY"))
    return F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))


def shard_calendar(spark: SparkSession, template: str, start: dt.date, end: dt.date) -> DataFrame:
    """Shard names of a date range, both ends included, by day with ``#mmdd#`` and by month with ``#mm#``."""
    return calendar_for(spark.range(1).select(F.lit(start).alias("s"), F.lit(end).alias("e")), "s", "e", template).select("shard")


def calendar_for(ranges: DataFrame, start: str, end: str, template: str) -> DataFrame:
    """Shard names for the date range of every row."""
    day = F.explode(_days(F.col(start), F.col(end), template))
    return ranges.withColumn("_day", day).withColumn("shard", S.fill_template(F.lit(template), F.col("_day"))).drop("_day")


def shard_coverage(expected: DataFrame, present: DataFrame, on: Sequence[str] = ("shard",)) -> DataFrame:
    """Shards only expected (``absent``) and shards only present (``extra``)."""
    on = list(on)
    both = expected.select(*on).distinct().withColumn("_e", F.lit(True)).join(
        present.select(*on).distinct().withColumn("_p", F.lit(True)), on, "full"
    )
    return both.filter(F.col("_e").isNull() | F.col("_p").isNull()).select(
        *on, F.when(F.col("_p").isNull(), "absent").otherwise("extra").alias("coverage")
    )


def shard_union(shards: Sequence[DataFrame]) -> DataFrame:
    """One table from all shards; columns a shard lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def shard_union_paths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The same from files, in one scan: the schemas are merged by the reader."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def shard_columns(table: str, ts: Column, by: str = "day") -> dict[str, Column]:
    """Schema and table name a row belongs to: ``x_db.t`` goes to ``x_<yyyy>_db.t_<mmdd>`` or ``t_<mm>``."""
    schema, name = table.split(".")
    stem = schema.removesuffix("_db")
    return {
        "shard_schema": F.concat(F.lit(f"{stem}_"), F.date_format(ts, "yyyy"), F.lit("_db")),
        "shard_table": F.concat(F.lit(f"{name}_"), F.date_format(ts, "MMdd" if by == "day" else "MM")),
    }
