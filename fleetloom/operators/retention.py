"""Backup ledger: tiered retention, latest usable, role preference, summaries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import scalars as S

# Fixed value: upper bound of the last age band, in days.
LAST_BAND_DAYS = 36600


def age_band(age: Column, rule: Column | str | None) -> Column:
    """Number of the band with ``first < age <= last``, NULL when none: today (age 0) is in no band.

    A rule given as text becomes a plain CASE; a rule column, one per row, needs an array expression.
    """
    if rule is None:
        return F.lit(None).cast("int")
    if isinstance(rule, str):
        edges = [*map(int, rule.split("-")), LAST_BAND_DAYS]
        found = [F.when((age > a) & (age <= b), F.lit(i + 1)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
        return F.coalesce(*found)
    bounds = F.concat(S.rule_array(rule), F.array(F.lit(LAST_BAND_DAYS)))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(bounds) - 1),
        lambda i: F.when((age > F.get(bounds, i - 1)) & (age <= F.get(bounds, i)), i),
    )
    return F.when(rule.isNotNull(), F.array_min(pairs))


def tiered_retention(
    ledger: DataFrame, groups: Sequence[str], day: str, row_id: str, today: dt.date, rule: Column | str | None,
    population: Column | None = None,
) -> DataFrame:
    """Ledger rows in the population with ``age_days``, ``band``, ``kept`` and ``reason``.

    Kept are the oldest and the newest row of each group and the newest row of each age band; ties go by ``row_id``.
    Groups of any size are reduced map-side to one candidate per band, and the keep list meets the ledger again on
    the full row identity, so a group that owns most of the ledger does not land in one task.
    """
    rows = ledger if population is None else ledger.filter(population)
    age = F.datediff(F.lit(today), F.col(day))
    rows = rows.withColumn("age_days", age).withColumn("band", age_band(F.col("age_days"), rule))
    key = F.struct(F.col(day), F.col(row_id))
    per_band = rows.groupBy(*groups, "band").agg(F.min(key).alias("_old"), F.max(key).alias("_new"))
    merged = per_band.groupBy(*groups).agg(
        F.min("_old").alias("_oldest"), F.max("_new").alias("_newest"),
        F.collect_list(F.when(F.col("band").isNotNull(), F.col("_new"))).alias("_bands"),
    )
    marks = F.concat(
        F.array(F.struct(F.col("_oldest").alias("k"), F.lit("oldest").alias("r")), F.struct(F.col("_newest").alias("k"), F.lit("newest").alias("r"))),
        F.transform("_bands", lambda b: F.struct(b.alias("k"), F.lit("band").alias("r"))),
    )
    keep = merged.select(*groups, F.explode(marks).alias("_m")).groupBy(*groups, F.col(f"_m.k.{row_id}").alias(row_id)).agg(
        F.concat_ws("+", F.array_sort(F.collect_set("_m.r"))).alias("reason")
    )
    # A NULL group is a group like any other: its only copies must be kept too.
    keep = keep.select(*[F.col(g).alias(f"_k_{g}") for g in [*groups, row_id]], "reason")
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_k_{g}")) for g in [*groups, row_id]])
    out = rows.join(keep, same, "left").drop(*[f"_k_{g}" for g in [*groups, row_id]])
    return out.withColumn("kept", F.col("reason").isNotNull())


def clear_list(
    ledger: DataFrame, groups: Sequence[str], day: str, row_id: str, today: dt.date, rule: Column | str | None,
    *, disk_used: float | None = None, disk_limit: float = 80.0, status: str = "backup_status", cleared: str = "clear_status",
    remote: str = "remote_backup_status",
) -> DataFrame:
    """Ledger rows to clear: good ones not kept, and failed ones not yet cleared. Empty while the disk is below its limit."""
    good = (F.col(status) == "Succ") & (F.col(cleared) == "todo") & (F.col(remote) == "todo")
    tiered = tiered_retention(ledger, groups, day, row_id, today, rule, good).filter(~F.col("kept"))
    failed = ledger.filter((F.col(status) == "Fail") & (F.col(cleared) != "done"))
    out = tiered.select(*ledger.columns, F.lit("not kept").alias("clear_reason")).unionByName(
        failed.withColumn("clear_reason", F.lit("failed"))
    )
    return out if disk_used is None or disk_used >= disk_limit else out.limit(0)


def latest_usable(ledger: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Sequence[str], usable: Column) -> DataFrame:
    """Newest usable row per group."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return ledger.filter(usable).groupBy(*groups).agg(newest).select(*groups, "_row.*")


def prefer_role(rows: DataFrame, groups: Sequence[str], role: str, ranking: Sequence[str], ties: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group: the best role of the ranking, ties by the given columns; other roles never win."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ranking]), F.col(role))
    best = F.min_by(F.struct(role, *columns), F.struct(rank, *ties)).alias("_row")
    return rows.filter(F.col(role).isin(list(ranking))).groupBy(*groups).agg(best).select(*groups, "_row.*")


def pair_summary(ledger: DataFrame, groups: Sequence[str], size: str, begin: str, end: str) -> DataFrame:
    """Rows, total size and longest run per group, for example per mode and day."""
    seconds = F.unix_timestamp(F.col(end)) - F.unix_timestamp(F.col(begin))
    return ledger.groupBy(*groups).agg(
        F.count("*").alias("runs"), F.sum(size).alias("total_size"), F.max(seconds).alias("longest_seconds")
    )


def status_rollup(chunks: DataFrame, task: Sequence[str], status: str, rows: str | None = None) -> DataFrame:
    """Fail if any chunk failed, else Succ, with chunks and rows."""
    counted = F.sum(rows) if rows else F.count("*")
    return chunks.groupBy(*task).agg(
        F.when(F.bool_or(F.col(status) == "Fail"), "Fail").otherwise("Succ").alias("exec_status"),
        F.count("*").alias("chunks"), counted.alias("row_count"),
    )


def run_summary(results: DataFrame, run: Sequence[str], status: str) -> DataFrame:
    """Successes, failures and unfinished per run."""
    s = F.col(status)
    return results.groupBy(*run).agg(
        F.count_if(s == "Succ").alias("succeeded"), F.count_if(s == "Fail").alias("failed"),
        F.count_if(~s.isin("Succ", "Fail")).alias("unfinished"),
    )


def gate_counts(df: DataFrame, gates: dict[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Several go/no-go counts in one pass."""
    return df.groupBy(*groups).agg(*[F.count_if(c).alias(n) for n, c in gates.items()])
