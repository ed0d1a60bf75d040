"""Row archiving: bounds, chunks, the split of a table into kept and archived rows, partition retirement."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions.skew import number_rows
from fleetloom.operators.tables import age_limit, older_than
from fleetloom.session import pin

SLICES = 64


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """First and last key and the row count in one pass; no rows give NULL bounds."""
    return df.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("row_count"))


def footprint(parts: DataFrame, groups: Sequence[str], data_bytes: str, index_bytes: str, rows: str) -> DataFrame:
    """Size in MB, rows and number of parts per table."""
    mb = F.sum(F.col(data_bytes) + F.col(index_bytes)) / 1024 / 1024
    return parts.groupBy(*groups).agg(F.round(mb, 4).alias("size_mb"), F.sum(rows).alias("table_rows"), F.count("*").alias("parts"))


def keyset_chunks(df: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """Consecutive chunks of ``chunk_rows`` rows in key order: number, first key, last key, rows.

    ``keys`` must be unique together. Only the key columns are shuffled.
    """
    keys = list(keys)
    numbered = number_rows(df.select(*keys), keys)
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    return (
        numbered.groupBy(F.floor((F.col("row_no") - 1) / chunk_rows).cast("long").alias("chunk_no"))
        .agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("chunk_rows"))
    )


def key_profile(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """One row per candidate column: type, rows, distinct values, NULLs, and whether it is a usable unique key.

    One scan. Every candidate's values are grouped as what they are, not as text, and then counted; both steps combine map-side, so
    no task sees more than its share of the values.
    """
    columns = list(candidates)
    counts = [x for i, c in enumerate(columns) for x in (F.count(c).alias(f"n{i}"), F.count_distinct(F.col(c)).alias(f"d{i}"))]
    found = df.agg(F.count("*").alias("row_count"), *counts)
    line = lambda i, c: F.struct(
        F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("column_type"), "row_count", F.col(f"d{i}").alias("distinct_values"),
        (F.col("row_count") - F.col(f"n{i}")).alias("nulls"), (F.col("row_count") == F.col(f"d{i}")).alias("usable"),
    )
    return found.select(F.inline(F.array(*[line(i, c) for i, c in enumerate(columns)])))


def unique_keys(df: DataFrame, columns: Sequence[str], most: int = 3, error: float = 0.02) -> list[tuple[str, ...]]:
    """Minimal sets of at most ``most`` of the ``columns`` that tell all rows apart; columns with NULLs take no part.

    Sets are tried by size, and only where no part of them is a key. One scan estimates the different values of all sets of
    a size; a set whose estimate is more than five of its errors below the number of rows is out. Of each other one the groups in one of
    SLICES slices of its hash are counted: a repeat there is proof enough. Only a set without any is decided by all groups, which
    combine map-side. A table without rows has no keys.
    """
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    n, usable = counts["n"], [c for i, c in enumerate(columns) if counts[f"c{i}"] == counts["n"]]
    found: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(usable, size) if n and not any(set(k) <= set(s) for k in found)]
        likely = []
        for part in (sets[i : i + 100] for i in range(0, len(sets), 100)):
            seen = df.agg(*[F.approx_count_distinct(F.xxhash64(*s), error).alias(f"s{i}") for i, s in enumerate(part)]).first()
            likely += [s for s, d in zip(part, seen) if d >= n * (1 - 5 * error)]
        found += [s for s in likely if not _repeats(df.filter(F.pmod(F.xxhash64(*s), F.lit(SLICES)) == 0), s) and not _repeats(df, s)]
    return found


def _repeats(df: DataFrame, columns: Sequence[str]) -> bool:
    return not df.groupBy(*columns).count().filter("count > 1").isEmpty()


@dataclass
class ArchiveSplit:
    """``sided`` is the whole table with a ``side`` column; ``archived`` and ``kept`` are its two halves."""

    sided: DataFrame
    archived: DataFrame
    kept: DataFrame
    chunks: DataFrame | None


def archive_split(
    df: DataFrame, time_col: str, today: dt.date, days: int, keys: Sequence[str] | None = None, chunk_rows: int = 20_000,
    task_id: str = "",
) -> ArchiveSplit:
    """Rows older than the threshold, the rest of the table, and one audit row per chunk of old rows.

    Rows without a time stay in the table, so the two sides always add up to it. Nothing is shuffled but the keys of
    the old rows, and those only when ``keys`` asks for the audit. To handle both sides in one scan use ``sided``.
    """
    limit = age_limit(df, time_col, today, days)
    old = older_than(df, time_col, today, days)
    kept = df.filter((F.col(time_col) >= limit) | F.col(time_col).isNull())
    sided = df.withColumn("side", F.when(F.col(time_col) < limit, "archived").otherwise("kept"))
    chunks = None
    if keys:
        chunks = keyset_chunks(old, keys, chunk_rows).withColumns({"task_id": F.lit(task_id), "exec_status": F.lit("Succ")})
    return ArchiveSplit(sided, old, kept, chunks)


def retirable_parts(parts: DataFrame, bound: str, threshold: dt.date) -> DataFrame:
    """Partitions whose upper bound, read as a date, lies below the threshold."""
    return parts.filter(F.to_date(F.try_to_timestamp(F.trim(F.col(bound).cast("string"), F.lit("'")))) < F.lit(threshold))


def _day(value: Column) -> Column:
    """The date a partition value names; one that names none is NULL and never retired."""
    return F.try_to_timestamp(value.cast("string"), F.lit("yyyy-MM-dd")).cast("date")


def _old_partitions(spark: SparkSession, table: str, column: str, threshold: dt.date) -> DataFrame:
    """(value) of the partitions below the threshold, from the catalog alone."""
    value = F.regexp_extract("partition", f"(?:^|/){re.escape(column)}=([^/]*)", 1)
    return spark.sql(f"SHOW PARTITIONS {table}").select(value.alias("value")).filter(_day(F.col("value")) < F.lit(threshold))


def _drop(spark: SparkSession, table: str, column: str, values: Iterator[str], page: int) -> None:
    """Drop partitions ``page`` at a time, one statement each: what a stopped run has dropped stays dropped."""
    while some := list(islice(values, page)):
        parts = ", ".join(f"PARTITION ({column} = '{v}')" for v in some)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")


def retire_partitions(spark: SparkSession, table: str, column: str, threshold: dt.date, page: int = 1_000) -> list[str]:
    """Drop the partitions of a table below the threshold, whole; returns the dropped values.

    Only partition names are read, never their rows.
    """
    old = sorted(r["value"] for r in _old_partitions(spark, table, column, threshold).distinct().collect())
    _drop(spark, table, column, iter(old), page)
    return old


def partition_sizes(df: DataFrame, column: str) -> DataFrame:
    """(value, files, row_count, size_mb) of every partition of ``df`` that has files.

    Rows are counted and sizes added up by file; no column is read, so a scan looks at file footers only.
    """
    meta = df.metadataColumn("_metadata")
    files = df.select(F.col(column).cast("string").alias("value"), meta["file_path"].alias("file"), meta["file_size"].alias("size"))
    files = files.groupBy("value", "file").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    mb = F.round(F.sum("size") / 1024 / 1024, 4).alias("size_mb")
    return files.groupBy("value").agg(F.count("*").alias("files"), F.sum("n").alias("row_count"), mb)


def retire_run(spark: SparkSession, table: str, column: str, threshold: dt.date, page: int = 1_000) -> DataFrame:
    """Drop the partitions below the threshold and report them: value, files, row_count, size_mb; an empty one has zeros.

    The report is pinned before anything is dropped. Nothing to drop gives an empty report.
    """
    old = _old_partitions(spark, table, column, threshold).distinct()
    sizes = partition_sizes(spark.table(table).filter(_day(F.col(column)) < F.lit(threshold)), column)
    report = pin(old.join(sizes, "value", "left").fillna(0, ["files", "row_count", "size_mb"]))
    _drop(spark, table, column, (r["value"] for r in report.select("value").toLocalIterator()), page)
    return report
