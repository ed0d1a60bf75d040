"""Upserts by unique key, as plain DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.skew import is_small
from fleetloom.session import pin


def last_by_arrival(batch: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """One row per key, the one that arrived last. Reduced map-side, so a key sent very often is harmless."""
    rest = [c for c in batch.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*arrival)).alias("_row")
    return batch.groupBy(*keys).agg(last).select(*keys, "_row.*")


def upsert_replace(target: DataFrame, batch: DataFrame, keys: Sequence[str], arrival: Sequence[str], defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Target after replacing rows by key.

    A replaced row is a new row: columns the batch does not supply take their default (NULL without one), never the
    old value. Use ``upsert_partial`` to keep old values. The keys of a batch of bounded size are broadcast, and the target is
    not shuffled.
    """
    defaults = defaults or {}
    new = pin(last_by_arrival(batch, keys, arrival))
    full = [
        F.col(f.name) if f.name in new.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ]
    named = new.select(*keys)
    untouched = target.join(F.broadcast(named) if is_small(named) else named, list(keys), "left_anti")
    return untouched.unionByName(new.select(*full))


def upsert_partial(target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Target after inserting new keys whole and, for known keys, taking over the ``update`` columns only.

    A NULL in the batch keeps the old value. A batch of bounded size is broadcast by its keys, so that untouched target rows
    stay where they are and only the rows it names are joined; a larger batch is merged by a shuffle of both sides.
    """
    keys = list(keys)
    new = pin(last_by_arrival(batch, keys, arrival))
    if not is_small(new):
        return _merge(target, new, keys, update)
    named = F.broadcast(new.select(*keys))
    untouched = target.join(named, keys, "left_anti")
    return untouched.unionByName(_merge(target.join(named, keys, "left_semi"), new, keys, update))


def _merge(target: DataFrame, new: DataFrame, keys: list[str], update: Sequence[str]) -> DataFrame:
    joined = target.withColumn("_old", F.lit(True)).alias("o").join(new.alias("n"), keys, "full")
    out = list(keys)
    for f in target.schema.fields:
        c = f.name
        if c in keys:
            continue
        have = F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(f.dataType)
        kept = F.coalesce(have, F.col(f"o.{c}")) if c in update else F.col(f"o.{c}")
        out.append(F.when(F.col("_old"), kept).otherwise(have).alias(c))
    return joined.select(*out).select(*target.columns)
