"""Projections and row filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetloom.functions import scalars as S
from fleetloom.functions.skew import lookup_join


def pivot_whitelist(
    df: DataFrame, keys: Sequence[str], name: str, value: str, wanted: Sequence[str], prefix: str = "", fold_case: bool = False
) -> DataFrame:
    """(name, value) rows to one wide row per key: listed names only, renamed to prefix + lower case."""
    label = F.lower(name) if fold_case else F.col(name)
    listed = [w.lower() for w in wanted] if fold_case else list(wanted)
    wide = (
        df.withColumn("_name", label).filter(F.col("_name").isin(listed))
        .groupBy(*keys).pivot("_name", listed).agg(F.max(value))
    )
    return wide.withColumnsRenamed({w: prefix + w.lower() for w in listed})


def unpivot_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide sample to (keys, metric, value) rows; values become double."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def null_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def typed_cast(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the types of ``schema``; what cannot be read becomes NULL."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def active_rows(df: DataFrame, state: str = "state", value: str = "online") -> DataFrame:
    return df.filter(F.col(state) == value)


def exclude_names(df: DataFrame, name: str, reserved: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    """Rows whose name is neither in the list nor matched by the pattern."""
    keep = ~F.col(name).isin(list(reserved)) if reserved else F.lit(True)
    if pattern:
        keep = keep & ~F.col(name).rlike(pattern)
    return df.filter(keep)


def age_limit(df: DataFrame, column: str, today: dt.date, days: int) -> Column:
    """Literal to compare ``column`` with: the date ``days`` ago, or for number columns its epoch at 00:00:01."""
    day = today - dt.timedelta(days=days)
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        midnight = dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc)
        return F.lit(int(midnight.timestamp()) + 1).cast("long")
    if isinstance(kind, T.StringType):
        return F.lit(day.isoformat())
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(day.isoformat()).cast(kind)
    raise TypeError(f"{column} is neither a time, a text nor a number")


def older_than(df: DataFrame, column: str, today: dt.date, days: int) -> DataFrame:
    """Rows strictly before ``today - days``."""
    return df.filter(F.col(column) < age_limit(df, column, today, days))


def key_range(df: DataFrame, key: str, first, last, closed: str = "both") -> DataFrame:
    """Rows with the key in the range, closed at both ends or at the left end only."""
    k = F.col(key)
    if closed == "both":
        return df.filter(k.between(first, last))
    if closed == "left":
        return df.filter((k >= first) & (k < last))
    raise ValueError("closed is 'both' or 'left'")


def like_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).like(pattern))


def shard_pattern(template: str) -> str:
    """Pattern that matches the shard names of a template from end to end."""
    out = template.replace(".", "\\.")
    for mark, digits in S.SHARD_DIGITS.items():
        out = out.replace(mark, digits)
    return f"^{out}$"


def shard_match(df: DataFrame, name: str, template: str) -> DataFrame:
    return df.filter(F.col(name).rlike(shard_pattern(template)))


def name_age_filter(
    df: DataFrame, name: str, prefix: str, today: dt.date, days: int, disk_used: float | None = None, disk_limit: float = 80.0
) -> DataFrame:
    """Names ``prefix_`` + ten digits whose first eight are a date more than ``days`` before ``today``.

    None while the disk is not above its limit.
    """
    if disk_used is not None and disk_used <= disk_limit:
        df = df.limit(0)
    digits = F.regexp_extract(F.col(name), f"^{prefix}_([0-9]{{8}})[0-9]{{2}}", 1)
    day = F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")
    return df.withColumn("name_date", day).filter(F.col("name_date") < F.lit(today - dt.timedelta(days=days)))


def in_daily_window(df: DataFrame, ts: str, start_sec: Column | int, end_sec: Column | int, closed: str = "neither") -> DataFrame:
    """Rows whose time of day is inside the window; ``closed`` is neither, right, left or both."""
    t = S.second_of_day(F.col(ts))
    low = (t >= start_sec) if closed in ("left", "both") else (t > start_sec)
    high = (t <= end_sec) if closed in ("right", "both") else (t < end_sec)
    return df.filter(low & high)


def weekday_due(day: Column, setting: Column) -> Column:
    """9 is due daily, 0 to 6 is due from that weekday (0 Sunday) on, any other setting is never due."""
    return F.when(setting == 9, F.lit(True)).when(
        setting.between(0, 6), setting <= S.weekday_number(day)
    ).otherwise(F.lit(False))


def breach(metric: Column, threshold: Column, inclusive: bool = False) -> Column:
    return (metric >= threshold) if inclusive else (metric > threshold)


def threshold_breach(df: DataFrame, metric: str, threshold: Column | float, inclusive: bool = False) -> DataFrame:
    """Rows above the threshold: strict for rates, delay and load, inclusive for disk use and lock counts."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.filter(breach(F.col(metric), limit, inclusive))


def role_and_lag(df: DataFrame, io_running: str, sql_running: str, behind: str) -> DataFrame:
    """Both threads at Yes make a slave with its lag; no status or a stopped thread makes a master with lag 0."""
    slave = (F.col(io_running) == "Yes") & (F.col(sql_running) == "Yes")
    return df.withColumns({
        "role": F.when(slave, "slave").otherwise("master"),
        "lag": F.when(slave, F.col(behind).try_cast("long")).otherwise(F.lit(0).cast("long")),
    })


def positions_equal(df: DataFrame, read_file: str, read_pos: str, done_file: str, done_pos: str) -> DataFrame:
    same = F.col(read_file).eqNullSafe(F.col(done_file)) & F.col(read_pos).eqNullSafe(F.col(done_pos))
    return df.withColumn("caught_up", same)


def next_action(status: Column) -> Column:
    """No run yet starts, a running one is checked, a good one needs nothing, any other is retried."""
    return (
        F.when(status.isNull(), "start").when(status == "Backing", "check").when(status == "Succ", "none").otherwise("retry")
    )


def next_actions(tasks: DataFrame, ledger: DataFrame, keys: Sequence[str], status: str, order: Sequence[str]) -> DataFrame:
    """Every task with the action its latest ledger row calls for."""
    latest = ledger.groupBy(*keys).agg(F.max_by(status, F.struct(*order)).alias("last_status"))
    return tasks.join(latest, list(keys), "left").withColumn("action", next_action(F.col("last_status")))


def derive_and_require(df: DataFrame, derived: Mapping[str, Column | str], text: str) -> DataFrame:
    """Add columns (expressions or SQL text) and keep the rows whose text is not empty."""
    columns = {k: F.expr(v) if isinstance(v, str) else v for k, v in derived.items()}
    return df.withColumns(columns).filter(F.length(text) > 0)


def project_catalogue(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Fixed column list, source name to output name."""
    return df.select(*[F.col(c).alias(a) for c, a in columns.items()])


def keys_filter(df: DataFrame, column: str, wanted: Sequence | DataFrame, spread: Sequence[str] = ()) -> DataFrame:
    """Rows whose ``column`` is in a short list or in a one-column table of keys."""
    if isinstance(wanted, DataFrame):
        return lookup_join(df, wanted.toDF(column), [column], "left_semi", spread=spread or df.columns)
    return df.filter(F.col(column).isin(list(wanted)))


def first_n(df: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_n(df: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def nth_row(df: DataFrame, order: Sequence[str], n: int, take: int = 2) -> DataFrame:
    """``take`` rows from row ``n`` on. For cutting a whole table use ``archive.keyset_chunks``."""
    return df.orderBy(*order).offset(n - 1).limit(take)


def keep_union(*keeps: DataFrame) -> DataFrame:
    """Union of keep lists without repeats."""
    out = keeps[0]
    for k in keeps[1:]:
        out = out.unionByName(k)
    return out.distinct()


def minus_keep(df: DataFrame, keep: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows not in the keep list, all rows when it is empty. ``on`` must identify a row, so no key is hot."""
    return df.join(keep.select(*on), list(on), "left_anti")
