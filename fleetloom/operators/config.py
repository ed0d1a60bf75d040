"""Layered configuration: the most specific online value wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetloom.functions.skew import BROADCAST_ROWS, is_small, lookup_join
from fleetloom.operators.tables import breach
from fleetloom.session import pin

DEFAULT_PORT = 65536
HOSTS_PER_TASK = 10_000


def tier_values(tier: DataFrame, keys: Sequence[str], value: str, state: str | None, out: str) -> DataFrame:
    """One value per key of the online rows; an empty value is none; two rows for a key raise an error."""
    online = tier.filter(F.col(state) == "online") if state else tier
    picked = online.groupBy(*keys).agg(F.max(value).alias("_value"), F.count("*").alias("_n"))
    clash = F.raise_error(F.concat(F.lit("more than one config row for "), F.concat_ws("/", *keys)))
    # The check is part of the value, or column pruning would drop it.
    checked = F.when(F.col("_n") > 1, clash.cast("string")).otherwise(F.nullif(F.col("_value"), F.lit("")))
    return picked.select(*keys, checked.alias(out))


def resolve_config(
    requests: DataFrame,
    person: DataFrame,
    common: DataFrame,
    local: DataFrame | None = None,
    *,
    key: str = "key",
    person_keys: Sequence[str] = ("key", "type", "server_host", "server_port"),
    value: str = "value",
    state: str = "state",
    host_wide: DataFrame | None = None,
    host_keys: Sequence[str] = ("key", "server_host"),
) -> DataFrame:
    """Add ``value``, ``source`` and ``missing`` to each request.

    Tiers from high to low: the row of this instance, the optional row of its host, the common row, the local file.
    The request columns must include ``person_keys``; a NULL port should be ``DEFAULT_PORT`` beforehand.
    """
    spread = list(dict.fromkeys([*person_keys, *requests.columns]))
    out = lookup_join(requests, tier_values(person, person_keys, value, state, "_person"), person_keys, spread=spread, derived=True)
    tiers: list[tuple[str, Column]] = [("person", F.col("_person"))]
    if host_wide is not None:
        out = lookup_join(out, tier_values(host_wide, host_keys, value, state, "_host"), host_keys, spread=spread, derived=True)
        tiers.append(("host", F.col("_host")))
    out = lookup_join(out, tier_values(common, [key], value, state, "_common"), [key], spread=spread, derived=True)
    tiers.append(("common", F.col("_common")))
    if local is not None:
        out = lookup_join(out, tier_values(local, [key], value, None, "_local"), [key], spread=spread, derived=True)
        tiers.append(("local", F.col("_local")))
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in tiers], F.lit("none"))
    return (
        out.withColumns({value: F.coalesce(*[c for _, c in tiers]), "source": source})
        .withColumn("missing", F.col(value).isNull()).drop("_person", "_host", "_common", "_local")
    )


def resolve_script_state(
    hosts: DataFrame, common: DataFrame, person: DataFrame, frequency: str, *, host: str = "server_host", max_broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Every script of a frequency on every host, with the host's own state before the common one.

    The list of scripts is measured. A small one is broadcast and hosts are widened in place; for a larger one the hosts are
    dealt into groups of about ``HOSTS_PER_TASK``, each group gets the list, and both sides are shuffled by group. Overrides,
    one row per host and script, are joined by both. ``max_broadcast_rows`` is the bound for either join.
    """
    scripts = pin(common.filter((F.col("state") == "online") & (F.col("frequency") == frequency)).select(
        F.col("basename").cast("string"), F.col("running_state").cast("string")
    ))
    small = is_small(scripts, max_broadcast_rows)
    groups = 1 if small else 1 + hosts.count() // HOSTS_PER_TASK
    asked = hosts.select(host, F.pmod(F.xxhash64(host), F.lit(groups)).alias("_group"))
    lists = scripts.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    all_runs = asked.join(F.broadcast(lists) if small else lists, "_group").drop("_group")
    own = (
        person.filter((F.col("state") == "online") & (F.col("frequency") == frequency))
        .groupBy(host, "basename").agg(F.nullif(F.max("running_state"), F.lit("")).alias("_own"))
    )
    out = lookup_join(all_runs, own, [host, "basename"], spread=[host, "basename"], derived=True, max_broadcast_rows=max_broadcast_rows)
    return out.select(
        host, "basename", F.coalesce("_own", "running_state").alias("running_state"),
        F.when(F.col("_own").isNotNull(), "person").otherwise("common").alias("source"),
    )


def config_map(resolved: DataFrame, keys: Sequence[str], key: str = "key", value: str = "value", wanted: Sequence[str] | None = None) -> DataFrame:
    """All keys of an instance as one map; ``wanted`` keeps only the keys that are re-read while running."""
    rows = resolved.filter(F.col(key).isin(list(wanted))) if wanted else resolved
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return rows.groupBy(*keys).agg(F.map_from_entries(pairs).alias("conf"))


def threshold_join(
    samples: DataFrame, thresholds: DataFrame, on: Sequence[str], metric: str, threshold: str,
    *, alarm_id: str, spread: Sequence[str], begin: Column, end: Column, inclusive: bool = False, derived: bool = False,
) -> DataFrame:
    """Alarm rows: samples above the threshold of their key, with id, text and time range."""
    joined = lookup_join(samples, thresholds, on, "inner", spread=spread, derived=derived)
    hit = joined.filter(breach(F.col(metric), F.col(threshold), inclusive))
    text = F.concat(
        F.lit("["), F.concat_ws(":", *on), F.lit("] "), F.lit(metric + " "), F.col(metric).cast("long").cast("string"),
        F.lit(" (threshold "), F.col(threshold).cast("long").cast("string"), F.lit(")"),
    )
    return hit.withColumns({"alarm_id": F.lit(alarm_id), "content": text, "range_begin": begin, "range_end": end})
