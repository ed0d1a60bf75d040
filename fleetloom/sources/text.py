"""Text sources: key-value files, dump metadata, log lines. Parsing is built-in expressions over a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.functions import scalars as S

# The layouts of the files that are read.
KEY_VALUE = r"^(\w+)\s*=\s*(.*)$"
MASTER_SECTION = "SHOW MASTER STATUS:"
SLAVE_SECTION = "SHOW SLAVE STATUS:"
POSITION = r"filename '([^']*)', position '([0-9]+)'"
ANSI = "\\x1B\\[[0-9;]*m"
# Time, then ` file]:message`, `] [file] [process] [level] [message]` or `] message`.
LOG_LINE = (
    r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)"
    r"(?: ([^\]\x01]+)\]:(.*)|\] \[([^\]\x01]+)\] \[\d+-[^\]]*\] \[([A-Z]+)\] \[(.*)\]|\] (.*))$"
)
MARK = "\x01"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_kv_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """``key=value`` lines to (key, value) rows; section heads, comments and other lines are left out."""
    line = F.trim(F.col(text))
    return lines.filter(line.rlike(KEY_VALUE)).select(
        *[c for c in lines.columns if c != text],
        F.regexp_extract(line, KEY_VALUE, 1).alias("key"), F.trim(F.regexp_extract(line, KEY_VALUE, 2)).alias("value"),
    )


def parse_section_metadata(
    files: DataFrame, text: str, source_host: Column, source_port: Column, io_running: Column, sql_running: Column,
    upstream_host: Column, upstream_port: Column, keep: Sequence[str] = (),
) -> DataFrame:
    """Sectioned dump metadata: start, end and the position to replicate from.

    The slave section counts only when both replication threads run; then the upstream is the master, otherwise the
    dumped server itself with the position of its master section.
    """
    t = F.col(text)

    def after(mark: str) -> Column:
        return F.when(t.contains(mark), F.substring_index(t, mark, -1))

    slave = F.coalesce((io_running == "Yes") & (sql_running == "Yes"), F.lit(False))
    section = F.when(slave, after(SLAVE_SECTION)).otherwise(F.substring_index(after(MASTER_SECTION), SLAVE_SECTION, 1))
    return files.select(
        *keep,
        F.when(slave, upstream_host).otherwise(source_host).alias("master_host"),
        F.when(slave, upstream_port).otherwise(source_port).cast("int").alias("master_port"),
        _found(section, r"Log: *([^\n]*?)\s*\n", 1).alias("master_log_file"),
        _found(section, r"Pos: *([0-9]+)", 1).try_cast("long").alias("master_log_pos"),
        S.lenient_time(F.regexp_extract(t, r"Started dump at: ([^\n]*)", 1)).alias("start_time"),
        S.lenient_time(F.regexp_extract(t, r"Finished dump at: ([^\n]*)", 1)).alias("end_time"),
    )


def info_field(text: Column, name: str) -> Column:
    return _found(text, rf"(?m)^{name} = ?(.*)$", 1)


def parse_info_metadata(files: DataFrame, text: str, source_host: Column, source_port: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``k = v`` info file; the binlog position is split into file and offset, unknown values are NULL."""
    t = F.col(text)
    position = info_field(t, "binlog_pos")
    return files.select(
        *keep, source_host.alias("master_host"), source_port.cast("int").alias("master_port"),
        _found(position, POSITION, 1).alias("master_log_file"), _found(position, POSITION, 2).try_cast("long").alias("master_log_pos"),
        S.lenient_time(info_field(t, "start_time")).alias("start_time"), S.lenient_time(info_field(t, "end_time")).alias("end_time"),
    )


def scan_log_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Log table from ``[time file]:msg``, ``[time] msg`` and the full logging layout; colours are stripped.

    A line of another shape has only ``rejected`` set. Each line is matched once: the match is rewritten to its fields
    with a mark in front of each, and then split.
    """
    others = [c for c in lines.columns if c != text]
    raw = lines.select(*others, F.regexp_replace(F.col(text), ANSI, "").alias("_raw"))
    fields = F.split(F.regexp_replace("_raw", LOG_LINE, f"{MARK}$1{MARK}$2$4{MARK}$5{MARK}$3$6$7"), MARK, 5)
    part = lambda i: F.try_element_at(F.col("_f"), F.lit(i))
    split = raw.withColumn("_f", F.when(~F.col("_raw").startswith(MARK), fields)).withColumn("ts", S.lenient_time(part(2)))
    known = F.col("ts").isNotNull()
    return split.select(
        *others, "ts", F.when(known, F.nullif(part(3), F.lit(""))).alias("file"), F.when(known, F.nullif(part(4), F.lit(""))).alias("level"),
        F.when(known, part(5)).alias("message"), F.when(~known, F.col("_raw")).alias("rejected"),
    )
