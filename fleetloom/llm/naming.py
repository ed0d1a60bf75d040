"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. Equal blocks get one integer name by sorting; adjacent names are paired, equal
pairs are named the same way, and so on until one name is left. Two texts of the same depth are equal if and only if their
last names are equal. No name rests on a hash alone: blocks are grouped by a 64-bit hash, but where one hash has several
contents, the contents themselves are sorted and told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.llm.common import discard, lower_ascii, with_row_id, write_out

SMALL_ROWS = 100_000  # colliding blocks to broadcast, at most; beyond that they are joined by a shuffle


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    starts = F.sequence(F.lit(0), F.expr(f"greatest(0, (octet_length(_t) - 1) div {block_bytes})"))
    cut = F.transform(starts, lambda i: F.substring(F.col("_b"), i * block_bytes + 1, F.lit(block_bytes)))
    return (
        rows.withColumn("_b", F.col("_t").cast("binary"))
        .withColumn("_n", F.expr(f"greatest(1, (octet_length(_t) + {block_bytes - 1}) div {block_bytes})"))
        .select("rid", "_id", "_sha", "_n", F.posexplode(cut).alias("i", "block")).withColumn("h", F.xxhash64("block"))
    )


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """Name distinct rows by their place after sorting; written, so that names stay."""
    return write_out(df.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()), "names")


def block_identity(df: DataFrame, text: str, doc_id: str, block_bytes: int = 4096) -> DataFrame:
    """(rid, _id, _sha, depth, name) for each row: rows with equal (depth, name) have equal texts after lower-casing A-Z."""
    rows = with_row_id(df.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_t")))
    rows = rows.select("rid", "_id", lower_ascii(F.col("_t")).alias("_t"))
    blocks = _blocks(rows.withColumn("_sha", F.sha2("_t", 256)), block_bytes)

    # One row per hash leaves each map task, however often a block repeats.
    contents = blocks.groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("set"))
    contents = contents.select("h", F.size("set").alias("k"), F.explode("set").alias("block"))
    names = _numbered(contents.select("h", "k", F.when(F.col("k") > 1, F.col("block")).alias("block")), "h", "block")
    clash = write_out(names.filter("k > 1").select("h").distinct().coalesce(1), "clash")
    n_clash = clash.count()
    clash = clash.withColumn("_clash", F.lit(True))
    if n_clash <= SMALL_ROWS:
        clash = F.broadcast(clash)
    told = blocks.join(clash, "h", "left").withColumn("block", F.when(F.col("_clash"), F.col("block"))).drop("_clash")
    level = write_out(
        told.join(names.drop("k").withColumnRenamed("block", "nb"), "h").filter(F.col("nb").isNull() | (F.col("nb") == F.col("block")))
        .select("rid", "_id", "_sha", "_n", "i", "name"), "level",
    )
    discard(names)
    done = [level.filter("_n = 1").select("rid", "_id", "_sha", F.lit(0).alias("depth"), "name")]
    most = level.agg(F.max("_n")).first()[0] or 1
    heads = level.filter("_n > 1 and i = 0").select("rid", "_id", "_sha")
    level, depth = level.filter("_n > 1").select("rid", "_n", "i", "name"), 0
    finished = None
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        pairs = level.groupBy("rid", F.expr("i div 2").alias("j"), F.expr("(_n + 1) div 2").alias("_m")).agg(
            F.max(F.expr("if(i % 2 = 0, name, null)")).alias("x"), F.coalesce(F.max(F.expr("if(i % 2 = 1, name, null)")), F.lit(-1)).alias("y"),
        )
        names = _numbered(pairs.select("x", "y").distinct(), "x", "y")
        level = write_out(pairs.join(names, ["x", "y"]).select("rid", F.col("_m").alias("_n"), F.col("j").alias("i"), "name"), "level")
        ready = level.filter("_n = 1").select("rid", F.lit(depth).alias("depth"), "name")
        finished = ready if finished is None else finished.union(ready)
        discard(names)
        level = level.filter("_n > 1")
    if finished is not None:
        done.append(heads.join(finished, "rid").select("rid", "_id", "_sha", "depth", "name"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest doc_id stays
    (null ids are smallest); of repeated rows with that same id exactly one is kept. An empty table gives no rows.
    Other columns of ``df`` are not read, whatever their names.
    """
    ids = write_out(block_identity(df, text, doc_id, block_bytes), "identity")
    # Written, so that the join below has two plain shuffles and Spark can split the rows of a very large group.
    groups = write_out(ids.groupBy("depth", "name").agg(F.max(F.struct("_id", "rid")).alias("top"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["depth", "name"]).select(
        F.col("_id").alias("doc_id"), F.col("top._id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"), F.col("_sha").alias("text_sha256"),
    )
