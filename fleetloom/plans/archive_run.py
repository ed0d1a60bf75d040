"""One archive run: split, write both sides, write the audit, roll up the task."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions import scalars as S
from fleetloom.functions.skew import number_rows
from fleetloom.operators.archive import archive_split, retire_partitions
from fleetloom.operators.config import resolve_config
from fleetloom.operators.retention import status_rollup
from fleetloom.operators.tables import active_rows, older_than


def run_archive(
    df: DataFrame, time_col: str, today: dt.date, days: int, keys: Sequence[str], chunk_rows: int, out: str, task_id: str,
) -> DataFrame:
    """Write both sides below ``out``/rows in one scan and the audit to ``out``/audit; returns the task row.

    The audit is taken from what was written: the keys of each chunk are looked up in the archived side, and a chunk that
    misses any is a Fail. A run without old rows is a Succ with no chunks. ``keys`` must be unique.
    The sides are the new folders ``side=archived`` and ``side=kept``: swap them in once the task says Succ.
    """
    spark = df.sparkSession
    split = archive_split(df, time_col, today, days)
    split.sided.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("side").parquet(f"{out}/rows")
    written = spark.read.schema(split.sided.schema).parquet(f"{out}/rows").filter(F.col("side") == "archived")
    audit_chunks(split.archived, written, keys, chunk_rows, task_id).write.mode("overwrite").parquet(f"{out}/audit")
    audit = spark.read.parquet(f"{out}/audit")
    task = status_rollup(audit, ["task_id"], "exec_status", "chunk_rows")
    moved = written.agg(F.count("*").alias("n")).scalar()
    task = task.withColumn("exec_status", F.when(F.col("row_count") == moved, F.col("exec_status")).otherwise("Fail"))
    ids = spark.createDataFrame([(task_id,)], "task_id string")
    return ids.join(task, "task_id", "left").select(
        "task_id", F.coalesce("exec_status", F.lit("Succ")).alias("exec_status"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )


def audit_chunks(old: DataFrame, written: DataFrame, keys: Sequence[str], chunk_rows: int, task_id: str) -> DataFrame:
    """One row per chunk of old rows: its key range, rows, rows found in what was written, and Succ or Fail."""
    numbered = number_rows(old.select(*keys), keys).withColumn("chunk_no", F.expr(f"(row_no - 1) div {chunk_rows}"))
    there = written.select(*keys).distinct().withColumn("_there", F.lit(1))
    key = F.struct(*keys)
    chunks = numbered.join(there, list(keys), "left").groupBy("chunk_no").agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("chunk_rows"), F.count("_there").alias("written_rows"),
    )
    status = F.when(F.col("written_rows") == F.col("chunk_rows"), "Succ").otherwise("Fail")
    return chunks.withColumns({"task_id": F.lit(task_id), "exec_status": status})


def archive_partitioned(spark: SparkSession, table: str, column: str, today: dt.date, days: int, out: str, backup: bool = True) -> list[str]:
    """The way for a table partitioned by its time column: copy the old partitions, then drop them whole.

    Only the old partitions are read, and no row of the others is rewritten. Returns the dropped partition values.
    """
    if not any(c.isPartition and c.name == column for c in spark.catalog.listColumns(table)):
        raise ValueError(f"{table} is not partitioned by {column}")
    if backup:
        old = older_than(spark.table(table), column, today, days)
        # Dynamic: partitions archived by earlier runs stay.
        old.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(f"{out}/archived")
        # One row per old partition on either side; nothing is dropped unless all of them agree.
        count = lambda df: df.select(F.col(column).cast("string").alias("part")).groupBy("part").count()
        copied = count(spark.read.parquet(f"{out}/archived")).withColumnRenamed("count", "copied")
        lost = count(old).join(copied, "part", "left").filter(F.coalesce("copied", F.lit(0)) != F.col("count"))
        if not lost.isEmpty():
            raise RuntimeError(f"{table}: the copy of a partition is not whole, nothing is dropped")
    return retire_partitions(spark, table, column, today - dt.timedelta(days=days))


def archive_tasks(archive_info: DataFrame, person: DataFrame, common: DataFrame, started: dt.datetime) -> DataFrame:
    """One task per online table to archive, with its id, chunk size and whether a copy is kept."""
    tables = active_rows(archive_info).withColumn("key", F.lit("archive_count"))
    sized = resolve_config(tables, person, common, person_keys=["key", "server_host", "server_port"])
    at = F.lit(started).cast("timestamp_ntz")
    return sized.select(
        S.instance_task_id(F.col("server_host"), F.col("server_port"), at).alias("task_id"), "server_host", "server_port",
        S.name_part(F.col("table"), 1).alias("table_schema"), S.name_part(F.col("table"), 2).alias("table_name"), "column", "keep_days",
        (F.upper("backup_status") == "Y").alias("backup"), F.col("value").try_cast("long").alias("chunk_rows"),
    )
