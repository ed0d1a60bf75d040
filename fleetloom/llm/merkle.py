"""Merkle dataset manifest by lag and lead windows.

Every row becomes a leaf, a digest of its fields. The leaves of a group are a row of nodes in order; ``fan`` neighbours make one
node of the next level, until one is left. Per level, lag and lead columns at the offsets 1 to fan - 1, masked by a node's
slot and the length of its run, give its left and right siblings, and the first row of a run hashes the parent. A run is one
window, so no window is larger than ``fan`` rows, however large the group. The roots of the groups make one more tree.

Texts are read once, for the leaves. Levels are written, so that each starts from rows that stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.skew import lookup_join, number_rows
from fleetloom.llm.common import discard, write_out

STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that ``leaf`` and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda at, s: digest(s["left"], at, s["right"]))


def siblings(steps: Column) -> Column:
    """All siblings of a leaf as one text, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")


def _runs(nodes: DataFrame, fan: int) -> tuple[DataFrame, Column, Column]:
    """Nodes that have a parent, with its place ``up`` and their ``slot``, and their siblings on the left and on the right."""
    nodes = nodes.filter("n > 1").selectExpr("*", f"pos div {fan} AS up", f"pos % {fan} AS slot", f"least({fan}, n - pos div {fan} * {fan}) AS length")
    run = "OVER (PARTITION BY tree, up ORDER BY slot)"
    before = [f"if(slot >= {k}, lag(h, {k}) {run}, '')" for k in range(fan - 1, 0, -1)]
    after = [f"if(slot + {k} < length, lead(h, {k}) {run}, '')" for k in range(1, fan)]
    return nodes, F.expr(f"concat({', '.join(before)})"), F.expr(f"concat({', '.join(after)})")


def levels(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """``nodes`` (tree, n, pos, h) and all levels above them; a tree with one node left (n = 1) goes no further."""
    found = [nodes]
    while most > 1:
        rows, _, after = _runs(found[-1].select("tree", "n", "pos", "h"), fan)
        heads = rows.withColumn("after", after).filter("slot = 0")
        above = heads.select("tree", F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), F.col("up").alias("pos"), digest(F.col("h"), F.col("after")).alias("h"))
        found.append(write_out(above, "nodes"))
        most = -(-most // fan)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """(tree, h): the node each tree ends in."""
    out = found[0].filter("n = 1").select("tree", "h")
    for level in found[1:]:
        out = out.union(level.filter("n = 1").select("tree", "h"))
    return out


def paths(found: list[DataFrame], end: Callable[[DataFrame], DataFrame], carry: Sequence[str], fan: int) -> DataFrame:
    """The nodes of the lowest level with their ``steps``: the siblings met on the way up.

    ``end`` gives the top node of a tree its ``steps`` and the columns ``carry``; they are handed down. A level is joined by
    run with the one above it, in the partitions that its windows have made.
    """
    above = None
    for i, level in reversed(list(enumerate(found))):
        own = level.columns
        out = end(level.filter("n = 1")).select(*own, *carry, "steps")
        if above is not None:
            rows, before, after = _runs(level, fan)
            met = rows.withColumn("_step", F.struct(before.alias("left"), after.alias("right"))).join(
                above.select("tree", F.col("pos").alias("up"), *carry, "steps"), ["tree", "up"]
            )
            out = out.union(met.select(*own, *carry, F.concat(F.array("_step"), F.col("steps")).alias("steps")))
        if i:
            written = write_out(out, "paths")
            if above is not None:
                discard(above)
            above = written
    return out


def merkle_proofs(
    df: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id",
    claim: Mapping[str, Column] | None = None, fan: int = 16,
) -> DataFrame:
    """One row per input row: ``order``, leaf, subroot, root, steps (the siblings up to the root) and claimed.

    A leaf is the digest of ``fields``. In a group leaves ascend by ``order``, nulls first, rows with equal ``order`` by their
    leaf; rows that are wholly alike may stand either way, their leaves are the same. Groups ascend by name, null first.
    ``claim`` replaces fields of a row, by columns of ``df``; ``claimed`` is the leaf of such a row (else the leaf itself), to
    be checked against the root. A group of one leaf is its own subroot, and so is a single group the root. An empty table gives no rows.
    Columns of ``df`` that are not named are not read, so their names don't matter.
    """
    claim = dict(claim or {})
    leaf = digest(*[field(F.col(f"`{c}`")) for c in fields])
    claimed = digest(*[field(claim.get(c, F.col(f"`{c}`"))) for c in fields]) if claim else F.lit(None).cast("string")
    # Null becomes '', any other name begins with a letter: the order of the names is kept.
    name = F.coalesce(F.concat(F.lit("g"), F.col(f"`{group}`").cast("string")), F.lit(""))
    # The last column tells rows that are alike apart, so that they can be dealt out; it is fixed once written.
    leaves = write_out(df.select(F.col(f"`{order}`").alias("k"), name.alias("g"), leaf.alias("h"), claimed.alias("c"), F.monotonically_increasing_id().alias("tie")), "leaves")
    numbered = number_rows(leaves, ["g", "k", "h", "tie"])
    groups = numbered.groupBy("g").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    groups = write_out(number_rows(groups, ["g"], "tree"), "groups")
    n_groups, most = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    nodes = lookup_join(numbered, groups, ["g"], "inner", spread=["row_no"])
    nodes = write_out(nodes.select("tree", "n", (F.col("row_no") - F.col("first")).alias("pos"), "h", "k", "c"), "level")
    discard(leaves)

    below = levels(nodes, most, fan)
    roots = tops(below).select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), (F.col("tree") - 1).alias("pos"), "h")
    upper = levels(write_out(roots, "subroots"), n_groups, fan)
    root = tops(upper).first()
    nothing = lambda top: top.withColumn("steps", F.array().cast(STEPS))
    over = paths(upper, nothing, [], fan).select((F.col("pos") + 1).alias("tree"), F.col("h").alias("subroot"), "steps")
    over = write_out(over, "subroots")
    out = paths(below, lambda top: top.join(over, "tree"), ["subroot"], fan)
    return out.select(
        F.col("k").alias(order), F.col("h").alias("leaf"), "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"), "steps",
        F.coalesce("c", "h").alias("claimed"),
    )
