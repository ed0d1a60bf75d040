"""Helpers that several text operators share: replayable row ids, written intermediates, components, byte views."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetloom.session import ship_package, shared_root, work_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MADE: dict[str, SparkSession] = {}
_C = ctypes.CDLL(None)
ASKED_BITS = 1 << 26  # size of a bitmap of asked rows: 8 MB whatever the input


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but space and the five control blanks; null has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def write_out(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    ship_package(spark)
    path = work_folder(spark, label)
    df.write.parquet(path, compression=codec)
    _MADE[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``write_out`` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            _remove(df.sparkSession, path)
            _MADE.pop(path, None)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished jobs now: it does so once the driver has collected their plans."""
    gc.collect()
    spark._jvm.System.gc()


def free_memory() -> None:
    """Hand what was freed back to the system: Python workers outlive their tasks, and others run beside them meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_C, "malloc_trim", None)
    if trim:
        trim(0)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def made_since(known: list[str] | None = None) -> list[str]:
    """Written tables that still exist and are not ``known``."""
    return [p for p in _MADE if p not in (known or ())]


def remove_made(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if _MADE.pop(path, None) is not None:
            _remove(spark, path)


@atexit.register
def _at_end() -> None:
    # Written intermediates belong to the session that made them and end with it.
    for path, spark in list(_MADE.items()):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


_PLAIN = re.compile(r"^[\s+:\-]*(Relation|Project|Filter|LocalRelation|LogicalRDD|Range|SubqueryAlias|View|Union)\b")


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row id that is the same each time the frame is evaluated.

    Scans are replayed in the same order, so their ids hold as they are; anything that shuffles is written first.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not all(_PLAIN.match(x) for x in plan.splitlines() if x.strip()):
        df = write_out(df, "rows")
    return df.withColumn(name, F.monotonically_increasing_id())


_SCAN = re.compile(r"^[\s+:\-]*(Relation\b.*\bparquet|(Project|Filter|SubqueryAlias|View)\b)")
MOST_FILES = 200_000  # file names to broadcast


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores in front, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def replayable(df: DataFrame) -> DataFrame:
    """A scan of files as it is; anything else is written first, so that it reads the same each time."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return df if all(_SCAN.match(x) for x in plan.splitlines() if x.strip()) else write_out(df, "rows")


def stable_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Add a row id that a row has in every job, whatever the executors and partitions at that moment.

    The id is the row's place: the number of its file, in order of name, and its index in the file. Beyond ``MOST_FILES``
    files the rows are written together with their ids.
    """
    df = replayable(df)
    meta = df.metadataColumn("_metadata")
    files = sorted(r[0] for r in df.select(meta["file_path"]).distinct().limit(MOST_FILES + 1).collect())
    if len(files) > MOST_FILES:
        return write_out(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    file, index, number = (free_name(df, x) for x in ("file_path", "row_index", "file_number"))
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), f"`{number}` long, `{file}` string")
    placed = df.select("*", meta["file_path"].alias(file), meta["row_index"].alias(index)).join(F.broadcast(numbers), file)
    place = F.shiftleft(F.col(number), 40).bitwiseOR(F.col(index))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


def task_total(df: DataFrame, column: Column) -> int:
    """Sum of a column over the whole frame (0 when empty)."""
    return int(df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: (node, root), root being the component's smallest node.

    Alternates large-star and small-star steps, each an aggregate with map-side combine and one join, so a node with
    very many neighbours is never gathered. Every round's edges are written and the round before is removed.
    """

    def tally(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(pairs, large):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        met = both.join(least, "u")
        if large:
            out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    now = write_out(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = tally(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        nxt = write_out(star(star(now, True), False), "edges")
        discard(now)
        now, before = nxt, seen
        seen = tally(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return tree.union(tree.select(F.col("root").alias("node"), "root").distinct())


def asked(near: DataFrame):
    """Bitmap, of one size at every size of the input, that has every number in the column ``short`` of ``near``, and by chance others."""
    at = F.pmod("short", F.lit(ASKED_BITS)) + 1
    parts = near.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(ASKED_BITS // 8, np.uint8)
    for n, bits in parts.toLocalIterator():
        out[(n - 1) * 4096 : n * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return near.sparkSession.sparkContext.broadcast(out.tobytes())


def is_asked(bitmap: bytes, short: np.ndarray) -> np.ndarray:
    at = short & (ASKED_BITS - 1)
    return np.frombuffer(bitmap, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing step on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))
