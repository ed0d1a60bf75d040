"""Replication chains: walk to the root, propose a shorter chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.skew import is_small, lookup_join
from fleetloom.session import pin, work_folder

STRIDE = 16  # nodes for each marked one


def healthy_edges(edges: DataFrame, child: str, parent: str, lag: str, max_lag: int) -> DataFrame:
    """Edges that may be followed: the lag is a number below the limit."""
    return edges.filter(F.col(lag).try_cast("long") < max_lag).select(F.col(child).alias("node"), F.col(parent).alias("up"))


def walk_chain(
    edges: DataFrame, child: str, parent: str, lag: str, max_lag: int = 3, max_broadcast_rows: int = 100_000, paths: DataFrame | bool = True
) -> DataFrame:
    """Root and depth of every node: ``node, root, depth, path, ended``.

    A child has one edge. The walk follows a hop only while its lag is below the limit. ``ended`` says why it stops:
    ``top`` (no edge above), ``lag`` (an edge that may not be followed) or ``cycle``. Each round every node takes over
    the walk of the node it has reached, so round r has ancestors 2^r hops up, in rows of one size whatever the depth. Who has
    not ended once the hops outnumber the nodes is in a cycle or below one, and has no root, depth or path.

    A table too large to broadcast is walked only up to the nearest of its marked nodes, one in STRIDE, which takes few rounds
    at any depth. The marked nodes are a table of their own, walked the same way, and every other node takes over the walk of its mark.

    ``paths`` names the nodes whose path is wanted (its first column; True means all, False none). A path is put together from the
    ancestors of all rounds; for other nodes it is NULL.
    """
    levels: list[list[DataFrame]] = []
    table = _walk(_written(_first_hops(edges, child, parent, lag, max_lag)), max_broadcast_rows, levels)
    acyclic = F.col("ended") != "cycle"
    found = table.select("node", F.when(acyclic, F.col("at")).alias("root"), F.when(acyclic, F.col("hops")).alias("depth"), "ended")
    if paths is False:
        return found.select("node", "root", "depth", F.lit(None).cast("string").alias("path"), "ended")
    wanted = table.filter(acyclic).select("node", "at", "hops")
    if paths is not True:
        wanted = lookup_join(wanted, paths.select(F.col(paths.columns[0]).alias("node")).distinct(), ["node"], "left_semi", spread=["node"], derived=True)
    return lookup_join(found, chain_paths(levels, pin(wanted)), ["node"], "left", spread=["node"], derived=True).select("node", "root", "depth", "path", "ended")


def _written(df: DataFrame) -> DataFrame:
    """``df`` from files. A checkpoint would hand on the planner's estimate of its size, which a join of a table with itself
    squares: over the rounds it becomes a number of millions of digits."""
    path = work_folder(df.sparkSession, "walk")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _marked(node: str, level: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(level)), F.lit(STRIDE)) == 0


def _walk(table: DataFrame, max_broadcast_rows: int, levels: list[list[DataFrame]]) -> DataFrame:
    """(node, at, hops, ended) of the whole walk of every row of ``table``, its first hops; adds the rounds of its levels to ``levels``."""
    n, level = table.count(), len(levels)
    small = n <= max_broadcast_rows and is_small(table, max_broadcast_rows)
    whole = small or n <= STRIDE * STRIDE
    parts = max(table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism)
    rounds = [table]
    levels.append(rounds)
    while 1 << (len(rounds) - 1) <= n:
        active = table.filter(F.col("ended").isNull())
        if active.isEmpty():
            break
        # A walk ends at a marked node; only roots have no hops.
        stop = F.lit(False) if whole else _marked("node", level) & (F.col("hops") > 0)
        above = table.select(
            F.col("node").alias("at"), F.when(stop, F.col("node")).otherwise(F.col("at")).alias("_at"),
            F.when(stop, 0).otherwise(F.col("hops")).alias("_hops"), F.when(stop, "mark").otherwise(F.col("ended")).alias("_ended"),
        )
        # Many nodes may have reached the same one: the join spreads them.
        moved = active.join(F.broadcast(above), "at") if small else lookup_join(active, above, ["at"], "inner", spread=["node"], max_broadcast_rows=0)
        moved = moved.select("node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"))
        # The rows are as many as before, so their partitions need not grow with the rounds.
        table = _written(table.filter(F.col("ended").isNotNull()).unionByName(moved).coalesce(parts))
        rounds.append(table)
    table = table.withColumn("ended", F.coalesce("ended", F.lit("cycle")))
    if whole:
        return table
    marks = table.filter(_marked("node", level) & (F.col("hops") > 0)).withColumn("ended", F.nullif("ended", F.lit("mark")))
    known = _walk(_written(marks.coalesce(parts)), max_broadcast_rows, levels)
    known = known.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"))
    rest = lookup_join(table.filter("ended = 'mark'"), known, ["at"], "inner", spread=["node"], max_broadcast_rows=max_broadcast_rows)
    rest = rest.select("node", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"))
    return _written(table.filter("ended <> 'mark'").unionByName(rest).coalesce(parts))


def _first_hops(edges: DataFrame, child: str, parent: str, lag: str, max_lag: int) -> DataFrame:
    """(node, at, hops, ended): every node with the hop above it that may be followed, or why there is none."""
    follow = F.when(F.col(lag).try_cast("long") < max_lag, F.col(parent))
    ends = F.array(
        F.struct(F.col(child).alias("node"), follow.alias("up"), F.lit(1).alias("edge")),
        F.struct(F.col(parent).alias("node"), F.lit(None).alias("up"), F.lit(0).alias("edge")),
    )
    nodes = edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.node").alias("node")).agg(
        F.max("e.up").alias("up"), F.sum("e.edge").alias("_n")
    )
    two = F.raise_error(F.concat(F.lit("more than one source for "), F.col("node").cast("string")))
    return nodes.select(
        "node", F.when(F.col("_n") > 1, two.cast(edges.schema[child].dataType)).otherwise(F.coalesce("up", "node")).alias("at"),
        F.col("up").isNotNull().cast("long").alias("hops"),
        F.when(F.col("up").isNotNull(), F.lit(None).cast("string")).when(F.col("_n") == 1, "lag").otherwise("top").alias("ended"),
    )


def chain_paths(levels: Sequence[Sequence[DataFrame]], wanted: DataFrame) -> DataFrame:
    """(node, path) of the ``wanted`` nodes (node, its root ``at``, ``hops``), each above the one before, joined by ``>``.

    A row is one place on one path. The places of the marked nodes come from the level above; those between two marks from
    the rounds of this one.
    """
    places = _places(levels, 0, wanted.select("node", F.lit(0).cast("long").alias("place"), F.col("node").alias("on")))
    places = places.unionByName(wanted.select("node", F.col("hops").alias("place"), F.col("at").alias("on"))).dropDuplicates(["node", "place"])
    on = F.array_sort(F.collect_list(F.struct("place", F.col("on").cast("string").alias("on"))))
    return places.groupBy("node").agg(F.array_join(F.transform(on, lambda x: x["on"]), ">").alias("path"))


def _places(levels: Sequence[Sequence[DataFrame]], level: int, places: DataFrame) -> DataFrame:
    """``places`` (node, place, on) and all that lie above them on the path, from this level up; the root may be missing.

    From the highest round down, every place known gives the one 2^r rows of this level above it, so d of them take log2(d) joins.
    """
    rounds, last = levels[level], level + 1 == len(levels)
    if not last:
        places = pin(places.unionByName(_places(levels, level + 1, _above(places, rounds[-1].filter("ended = 'mark'")))))
    for table in reversed(rounds):
        inside = F.col("ended").isNull() if last else F.col("ended").isNull() & ~_marked("at", level)
        # Dealt out anew, as the union would double the partitions each time.
        places = pin(places.unionByName(_above(places, table.filter(inside))).hint("rebalance"))
    return places


def _above(places: DataFrame, jump: DataFrame) -> DataFrame:
    jump = jump.select(F.col("node").alias("on"), F.col("at").alias("_at"), F.col("hops").alias("_hops"))
    if is_small(places):
        met = jump.join(F.broadcast(places), "on")
    else:
        met = lookup_join(places, jump, ["on"], "inner", spread=["node", "place"])
    return met.select("node", (F.col("place") + F.col("_hops")).alias("place"), F.col("_at").alias("on"))


def promote_grandparent(edges: DataFrame, child: str, parent: str, lag: str, max_lag: int = 3, max_broadcast_rows: int = 100_000) -> DataFrame:
    """For each child with two healthy hops above it: the present parent and the proposed one."""
    good = healthy_edges(edges, child, parent, lag, max_lag)
    lower = good.select(F.col("node").alias("child"), F.col("up").alias("parent"))
    upper = good.select(F.col("node").alias("parent"), F.col("up").alias("proposed"))
    return lookup_join(lower, upper, ["parent"], "inner", spread=["child"], max_broadcast_rows=max_broadcast_rows)
