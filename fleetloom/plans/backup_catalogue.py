"""The backup ledger of all instances at once: due tasks, their next action, what to clear."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions import scalars as S
from fleetloom.operators.retention import clear_list
from fleetloom.operators.tables import active_rows, next_action, weekday_due
from fleetloom.functions.skew import lookup_join


def due_tasks(backup_info: DataFrame, ledger: DataFrame, today: dt.date) -> DataFrame:
    """Tasks due today (type, mode, task_id) with the action their ledger row calls for."""
    day = F.lit(today)
    online = active_rows(backup_info).filter(F.lower("mode_state") == "online")
    due = online.filter(weekday_due(day, F.col("weekday"))).withColumn("task_id", S.run_task_id(F.col("type"), day, F.col("mode")))
    state = ledger.groupBy("task_id").agg(F.max_by("backup_status", F.struct("start_time")).alias("last_status"))
    joined = due.join(state, "task_id", "left")
    return joined.select("type", "mode", "task_id", next_action(F.col("last_status")).alias("action"))


def clear_plan(backup_info: DataFrame, ledger: DataFrame, today: dt.date, disk_used: float | None = None, disk_limit: float = 80.0) -> DataFrame:
    """Ledger rows to clear under the rule of their instance and mode."""
    rules = active_rows(backup_info).select("type", "mode", F.array_join(F.col("clear_rule").cast("array<string>"), "-").alias("_rule"))
    ruled = lookup_join(ledger, rules, ["type", "mode"], "left", spread=["task_id"])
    return clear_list(
        ruled, ["type", "mode"], "date", "task_id", today, F.col("_rule"), disk_used=disk_used, disk_limit=disk_limit
    ).drop("_rule")
