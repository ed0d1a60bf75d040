"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.operators import shards
from fleetloom.operators.retention import latest_usable
from fleetloom.operators.upserts import upsert_replace


def scan_table(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None, fmt: str = "parquet",
    schema=None, **options: str,
) -> DataFrame:
    """A table from files; columns and filter reach the scan."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def scan_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 64, properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table or query result from a database, read in parallel ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition_column:
        low, high = bounds or (0, 2**31 - 1)
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", low).option("upperBound", high)
            .option("numPartitions", partitions)
        )
    return reader.load()


def unknown_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The stored 'unknown' date or time of 1970-01-01 00:00:00 read as NULL."""
    zero = {c: F.lit("1970-01-01").cast(df.schema[c].dataType) for c in columns}
    return df.withColumns({c: F.nullif(F.col(c), z) for c, z in zero.items()})


def null_to_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same the other way, for output that must not hold NULL."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("1970-01-01").cast(df.schema[c].dataType)) for c in columns})


def ensure_table(df: DataFrame, table: str, path: str | None = None, partition_by: Sequence[str] = ()) -> bool:
    """Create an empty table with the columns of ``df`` unless it exists; True when it was created."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        return False
    writer = df.limit(0).write.format("parquet")
    if path:
        writer = writer.option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    return True


def route_by_date(df: DataFrame, table: str, ts: str, path: str, by: str = "day", mode: str = "append") -> DataFrame:
    """Write each row below the schema and table of its date; returns the written data for reading.

    Rows are gathered by target first, so a task writes few files. The gathering is a rebalance: adaptive execution
    cuts a busy day into several tasks and merges the quiet ones.
    """
    routed = df.withColumns(shards.shard_columns(table, F.col(ts), by))
    routed.hint("rebalance", F.col("shard_schema"), F.col("shard_table")).write.mode(mode).partitionBy(
        "shard_schema", "shard_table"
    ).parquet(path)
    return df.sparkSession.read.parquet(path)


def export_chunked(df: DataFrame, schema: str, path: str, max_rows: int, only: Sequence[str] | None = None) -> DataFrame:
    """Write the selected schemas, a folder each, in files of at most ``max_rows`` rows; returns the manifest.

    The manifest (schema, file, rows) is counted from the written files. Rows are rebalanced by schema first: few
    files per task, and a schema that holds most rows is written by many tasks.
    """
    rows = df.filter(F.col(schema).isin(list(only))) if only else df
    # Static: an export replaces the whole folder, also the schemas it does not select.
    writer = rows.hint("rebalance", F.col(schema)).write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.option("maxRecordsPerFile", max_rows).partitionBy(schema).parquet(path)
    written = df.sparkSession.read.parquet(path).select(schema, F.col("_metadata.file_path").alias("file"))
    return written.groupBy(schema, "file").agg(F.count("*").alias("file_rows"))


def restore_latest(
    spark: SparkSession, ledger: DataFrame, instance: str, name, order: Sequence[str], path: str, usable: Column
) -> DataFrame:
    """Load the newest usable export of one instance."""
    newest = latest_usable(ledger.filter(F.col(instance) == name), [instance], order, [path], usable).first()
    if newest is None:
        raise LookupError(f"no usable export of {name}")
    return spark.read.parquet(newest[path])


def load_replace(archive: DataFrame, extract: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Archive copy after loading an extract, replacing rows by key."""
    return upsert_replace(archive, extract, keys, arrival)
