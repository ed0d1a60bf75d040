"""From raw samples to alarms: pivot, rate, threshold, convergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetloom.operators.alarms import converge_time
from fleetloom.operators.config import resolve_config, threshold_join
from fleetloom.operators.rates import counter_rate


def rate_alarms(
    samples: DataFrame, person: DataFrame, common: DataFrame, *, keys: Sequence[str], slot: str, written: str, counter: str,
    config_key: str, step_seconds: int, alarm_id: str,
) -> DataFrame:
    """Alarms of one counter on all instances. The keys are also the columns of the person tier."""
    rates = counter_rate(samples, keys, slot, written, [counter], step_seconds)
    asked = samples.select(*keys).distinct().withColumn("key", F.lit(config_key))
    limits = resolve_config(asked, person, common, person_keys=["key", *keys]).filter(~F.col("missing"))
    limits = limits.select(*keys, F.col("value").try_cast("double").alias("threshold"))
    begin = F.col(slot) - F.expr(f"INTERVAL {int(step_seconds)} SECONDS")
    return threshold_join(
        rates, limits, keys, f"{counter}_rate", "threshold", alarm_id=alarm_id, spread=[*keys, slot], begin=begin, end=F.col(slot),
        derived=True,
    )


def converged_rate_alarms(alarms: DataFrame, keys: Sequence[str], slot: str, slot_seconds: int) -> DataFrame:
    return converge_time(alarms, keys, slot, [], slot_seconds)
