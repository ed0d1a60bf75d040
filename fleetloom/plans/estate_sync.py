"""Backup settings brought in line with the instances that exist."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators.reconcile import mark_absent
from fleetloom.operators.retention import prefer_role
from fleetloom.operators.tables import active_rows
from fleetloom.operators.upserts import upsert_partial

SOURCE_ROLES = ("Masterbackup", "Slave")


def sync_backup_info(backup_info: DataFrame, instances: DataFrame, address: str, new_row: Mapping[str, object]) -> DataFrame:
    """``backup_info`` (one row per ``type``) after a sync.

    Clusters without an online master go offline, and so do those without an online replica to back up from. The others
    take the preferred replica as their source and keep their state: it may have been switched off by hand. New
    clusters get ``new_row`` as their settings.
    """
    online = active_rows(instances)
    clusters = online.filter(F.col("role") == "Master").select("type").distinct()
    source = prefer_role(
        online, ["type"], "role", SOURCE_ROLES, ["server_host", "server_port"], ["server_host", "server_port"]
    ).select("type", F.col("server_host").alias("source_host"), F.col("server_port").alias("source_port"))
    usable = source.join(clusters, "type", "left_semi")
    kept = mark_absent(backup_info, usable, "type", "state", ["type"])
    batch = usable.withColumns({"address": F.lit(address), "_seq": F.lit(1), **{c: F.lit(v) for c, v in new_row.items()}})
    return upsert_partial(kept, batch, ["type"], ["address", "source_host", "source_port"], ["_seq"])
