"""Joins, lags and row numbers that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.session import pin, work_folder

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1_000
HOT_ROWS = 1_000_000
SALTS = 64
MOST_SALTS = 100_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if ``df`` has at most ``max_rows`` rows and, written as JSON, at most ``max_bytes`` bytes.

    The count reads no columns; bytes are measured only where it has passed. Both are added up map-side.
    """
    if df.count() > max_rows:
        return False
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0))).first()[0]
    return size <= max_bytes


def hot_keys(df: DataFrame, on: Sequence[str], share: int = HOT_SHARE, min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than 1/``share`` of all rows and more than ``min_rows``: never more than ``share`` rows."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    return counts.filter((F.col("_n") > min_rows) & (F.col("_n") * share > total)).select(*on, "_n")


def mark_hot(df: DataFrame, keys: Sequence[str], share: int, min_rows: int) -> DataFrame:
    """Add ``_hot``: true for the rows of hot keys, else NULL. The hot keys, at most ``share``, are broadcast."""
    hot = pin(hot_keys(df, keys, share, min_rows)).select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    return df.join(F.broadcast(hot), same, "left").drop(*[f"_h_{k}" for k in keys])


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    spread: Sequence[str],
    derived: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
    hot_share: int = HOT_SHARE,
    hot_min_rows: int = HOT_ROWS,
    salts: int | None = None,
    max_broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``facts`` to ``dim`` on ``on``; ``how`` is left, inner, left_semi or left_anti.

    ``dim`` is measured first. Up to ``max_broadcast_rows`` and ``max_broadcast_bytes`` it is broadcast and ``facts`` is
    not shuffled. Beyond that both sides are shuffled. Rows of a hot key are spread by a hash of ``spread`` (columns that
    identify a fact row) over as many groups as it has ``hot_min_rows`` (or over ``salts``, if given), and the few hot
    ``dim`` rows are repeated for each group. The hot keys and their counts are found once and pinned.
    A ``derived`` dim, the result of a larger computation, is pinned first so that counting it does not run it twice.
    """
    on = list(on)
    if derived:
        dim = pin(dim)
    if is_small(dim, max_broadcast_rows, max_broadcast_bytes):
        return facts.join(F.broadcast(dim), on, how)
    groups = F.lit(salts) if salts else F.least(F.lit(MOST_SALTS), 1 + F.expr(f"_n div {max(1, hot_min_rows)}"))
    hot = pin(hot_keys(facts, on, hot_share, hot_min_rows).select(*on, groups.cast("int").alias("_hot")))
    # Rows without a key match nothing and would otherwise gather in one task.
    no_key = reduce(or_, [F.col(k).isNull() for k in on])
    spread_over = F.when(no_key, F.lit(MOST_SALTS)).otherwise(F.coalesce("_hot", F.lit(1)))
    salt = F.pmod(F.xxhash64(*spread), spread_over).cast("int")
    copies = F.sequence(F.lit(0), F.coalesce("_hot", F.lit(1)) - 1)
    # `hot` has at most `hot_share` rows by construction, so broadcasting it is bounded.
    left = facts.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    right = dim.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def time_slice(ts: Column, seconds: int) -> Column:
    """Number of the fixed slice of ``seconds`` that holds ``ts``."""
    return F.floor(F.unix_timestamp(ts) / F.lit(seconds)).cast("long")


def previous_sample(
    df: DataFrame, keys: Sequence[str], ts: str, carry: Sequence[str], slice_seconds: int = 86_400
) -> DataFrame:
    """Add ``prev_<ts>`` and ``prev_<column>`` from the sample before each one, NULL for the first of a key.

    ``(keys, ts)`` must be unique. The window runs per key and time slice, so one busy key is many small groups;
    the last sample of every slice is handed to the next slice of its key that has any.
    """
    keys, columns = list(keys), [ts, *carry]
    sliced = df.withColumn("_slice", time_slice(F.col(ts), slice_seconds))
    # Column by column, so that numbers and times are aggregated by hash.
    last = sliced.groupBy(*keys, "_slice").agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in carry])
    slices = Window.partitionBy(*keys).orderBy("_slice")
    halo = last.select(
        *keys, "_slice", *[F.lag(c).over(slices).alias(c) for c in columns], F.lit(True).alias("_halo")
    ).filter(F.col(ts).isNotNull())
    both = sliced.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy(ts)
    before = {f"prev_{c}": F.lag(c).over(w) for c in columns}
    return both.withColumns(before).filter(~F.col("_halo")).drop("_halo", "_slice")


def carry_values(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], slice_seconds: int = 86_400) -> DataFrame:
    """Add ``before_slot``, the time of the sample before, and ``before_<value>``, the last known value before each sample.

    ``(keys, ts)`` must be unique. Works in time slices as ``previous_sample`` does.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", time_slice(F.col(ts), slice_seconds))
    # max_by passes over rows whose order is NULL, so each value is the last known one of its slice.
    last = sliced.groupBy(*keys, "_slice").agg(
        F.max(ts).alias(ts), *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(ts))).alias(v) for v in values]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    halo = last.select(
        *keys, "_slice", F.last(ts, ignorenulls=True).over(earlier).alias(ts),
        *[F.last(v, ignorenulls=True).over(earlier).alias(v) for v in values], F.lit(True).alias("_halo"),
    ).filter(F.col(ts).isNotNull())
    both = sliced.withColumn("_halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy(ts)
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    found = {"before_slot": F.lag(ts).over(w), **{f"before_{v}": F.last(v, ignorenulls=True).over(so_far) for v in values}}
    return both.withColumns(found).filter(~F.col("_halo")).drop("_halo", "_slice")


def ordinal_in_key(
    df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], slice_seconds: int = 60, name: str = "ordinal",
    hot_share: int = 100_000, hot_min_rows: int = 100_000,
) -> DataFrame:
    """Add ``name``: 1-based position of each row within its key, by ``ts`` then ``ties``.

    Ordinary keys are ranked whole. Keys with more than ``hot_min_rows`` rows and more than 1/``hot_share`` of all are
    ranked inside time slices; a running total of the slice counts gives each slice its start, which joins the slice
    as a marker row in front of its rows.
    """
    keys = list(keys)
    # Rows without a time come first, as they would in one sorted group.
    number = F.when(F.col("_hot"), F.coalesce(time_slice(F.col(ts), slice_seconds), F.lit(-(1 << 40))))
    sliced = mark_hot(df, keys, hot_share, hot_min_rows).withColumn("_slice", number).drop("_hot")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.filter(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    both = sliced.unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy(F.col("_start").isNull(), ts, *ties)
    # In a slice the marker is row 1, so its first real row is row 2.
    place = F.row_number().over(w) + F.coalesce(F.first("_start", ignorenulls=True).over(w) - 1, F.lit(0))
    return both.withColumn(name, place.cast("long")).filter(F.col("_start").isNull()).drop("_slice", "_start")


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str]) -> DataFrame:
    """First ``n`` rows of every group by ``order``.

    For small ``n`` Spark cuts each group to ``n`` rows before the shuffle. For larger ``n`` the group is first
    cut inside hash slices of ``spread``, so a hot group is never sorted by one task as a whole.
    """
    keys = list(keys)
    if n >= 1_000:
        piece = Window.partitionBy(*keys, "_piece").orderBy(*order)
        df = (
            df.withColumn("_piece", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
            .withColumn("_rank", F.row_number().over(piece)).filter(F.col("_rank") <= n).drop("_piece", "_rank")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n).drop("_rank")


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str = "row_no") -> DataFrame:
    """Add a gapless 1-based number over the whole table in ``order``, without a single-task window.

    The rows are range-partitioned, sorted inside the partitions and written to the shared folder with their partition
    and position, so that a lost executor cannot move a row to another place. Only the row count of each partition
    reaches the driver, to become that partition's starting number.
    """
    spark = df.sparkSession
    path = work_folder(spark, "numbered")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )
    placed.write.parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    sizes = written.groupBy("_part").agg(F.count("*").alias("n")).collect()
    starts, start = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in sizes):
        starts.append((part, start))
        start += n
    offsets = spark.createDataFrame(starts, "_part int, _start long")
    # One row per partition.
    return (
        written.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos") + F.lit(1)).drop("_part", "_pos", "_start")
    )
