"""Inventories and cluster membership: segments, peers, absent clusters, sessions to protect against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.skew import lookup_join


def drop_open_segment(segments: DataFrame, source: Sequence[str], name: str) -> DataFrame:
    """All but the newest segment of every source; the newest may still grow.

    The newest ones are removed by full identity (source and name), which spreads a source with many segments.
    """
    newest = segments.groupBy(*source).agg(F.max(name).alias(name))
    return segments.join(newest, [*source, name], "left_anti")


def first_segment(segments: DataFrame, source: Sequence[str], name: str, columns: Sequence[str]) -> DataFrame:
    """Oldest segment of every source."""
    oldest = F.min_by(F.struct(name, *columns), F.col(name)).alias("_row")
    return segments.groupBy(*source).agg(oldest).select(*source, "_row.*")


def inventory_reconcile(
    expected: DataFrame, held: DataFrame, source: Sequence[str], name: str, size: str, *, drop_open: bool = True,
    report_missing: bool = False, report_unexpected: bool = False,
) -> DataFrame:
    """Status of each segment: ``Succ`` with its size, ``Fail`` with size 0 when the sizes differ.

    Options add the absent ones as ``Missing`` and files nobody expects as ``Unexpected``.
    """
    on = [*source, name]
    due = drop_open_segment(expected, source, name) if drop_open else expected
    left = due.select(*on, F.col(size).alias("_want"))
    right = held.select(*on, F.col(size).alias("_have"))
    how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}
    both = left.join(right, on, how[(report_missing, report_unexpected)])
    if report_unexpected and drop_open:
        # A held copy of the open segment is expected, only not checked yet.
        newest = expected.groupBy(*source).agg(F.max(name).alias(name))
        both = both.join(newest, on, "left_anti")
    status = (
        F.when(F.col("_have").isNull(), "Missing").when(F.col("_want").isNull(), "Unexpected")
        .when(F.col("_want") == F.col("_have"), "Succ").otherwise("Fail")
    )
    return both.withColumn("status", status).select(
        *on, "status",
        F.when(F.col("status").isin("Succ", "Unexpected"), F.col("_have")).otherwise(F.lit(0)).cast("long").alias("size"),
    )


def peers_of(instances: DataFrame, masters: DataFrame, cluster: str, keys: Sequence[str], role: str, peer_role: str = "Slave") -> DataFrame:
    """Instances in the role that share a cluster with one of the given masters."""
    clusters = instances.join(masters.select(*keys), list(keys), "left_semi").select(cluster).distinct()
    peers = instances.filter(F.col(role) == peer_role)
    return lookup_join(peers, clusters, [cluster], "left_semi", spread=keys, derived=True)


def mark_absent(rows: DataFrame, active: DataFrame, cluster: str, state: str, spread: Sequence[str]) -> DataFrame:
    """Rows with the state set to offline where the cluster is not in the active list; an empty list means all."""
    listed = active.select(cluster).distinct().withColumn("_active", F.lit(True))
    out = lookup_join(rows, listed, [cluster], "left", spread=spread, derived=True)
    return out.withColumn(state, F.when(F.col("_active"), F.col(state)).otherwise("offline")).drop("_active")


def protect_candidates(
    sessions: DataFrame, instances: DataFrame, instance: str, user: Column, *, state: str, role: str, lag: str, session_id: str,
    waiting_like: str = "%Waiting%lock%", max_waiting: int = 10, max_lag: int = 120,
) -> DataFrame:
    """Sessions of the backup user on instances in trouble.

    In trouble is an instance with waiting sessions that has at least ``max_waiting`` of them, or is a slave at least
    ``max_lag`` behind. Lists the sessions, ends none.
    """
    waiting = sessions.groupBy(instance).agg(F.count_if(F.col(state).like(waiting_like)).alias("waiting"))
    trouble = instances.join(waiting, instance).filter(
        (F.col("waiting") > 0)
        & ((F.col("waiting") >= max_waiting) | ((F.col(role) == "slave") & (F.col(lag) >= max_lag)))
    ).select(instance, role, lag, "waiting")
    return lookup_join(sessions.filter(user), trouble, [instance], "inner", spread=[instance, session_id], derived=True)
