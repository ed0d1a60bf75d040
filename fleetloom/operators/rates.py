"""Rates and ratios from cumulative counters and gauges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetloom.functions import scalars as S
from fleetloom.operators.tables import breach

NO_RESULT = "NO_RESULT"


def with_step_before(
    samples: DataFrame, keys: Sequence[str], slot: str, carry: Sequence[str], step_seconds: int, slice_steps: int = 1_440,
) -> DataFrame:
    """Add ``before_<column>`` from the sample exactly one step earlier, and ``paired``, whether there is one.

    ``(keys, slot)`` must be unique. One shuffle: a sample goes to the time slice of its key that holds it, and
    also to the next slice when its successor falls there. A group has at most ``slice_steps`` + 1 rows.
    """
    keys, length = list(keys), step_seconds * slice_steps
    at = F.unix_timestamp(F.col(slot))
    own, nxt = F.floor(at / length).cast("long"), F.floor((at + step_seconds) / length).cast("long")
    slices = F.when(own == nxt, F.array(own)).otherwise(F.array(own, nxt))
    w = Window.partitionBy(*keys, "_slice").orderBy(slot)
    before = {f"before_{c}": F.lag(c).over(w) for c in carry}
    placed = samples.withColumn("_own", own).withColumn("_slice", F.explode(slices))
    found = placed.withColumns({"_last": F.lag(slot).over(w), **before}).filter(F.col("_own") == F.col("_slice"))
    paired = F.coalesce(F.unix_timestamp("_last") == at - step_seconds, F.lit(False))
    return found.withColumn("paired", paired).withColumns(
        {c: F.when(F.col("paired"), F.col(c)) for c in before}
    ).drop("_own", "_slice", "_last")


def counter_rate(
    samples: DataFrame, keys: Sequence[str], slot: str, written: str, counters: Sequence[str], step_seconds: int = 60,
    mode: str = "abs", drop_zero: bool = True,
) -> DataFrame:
    """Change per second of each counter against the sample one step earlier, divided by the time between writes.

    Output: keys, slot, ``<counter>_rate`` and, in ``reset_aware`` mode, ``<counter>_reset``. Rows without a partner
    are dropped; see ``no_result_markers``. ``abs`` turns a counter restart into a spike, as the plain formula does;
    ``reset_aware`` yields NULL there. With ``drop_zero`` a pair with a zero on either side counts as no pair;
    when several counters are given that makes the single rate NULL.
    """
    paired = with_step_before(samples, keys, slot, [written, *counters], step_seconds).filter("paired")
    return paired_rates(paired, keys, slot, written, counters, mode, drop_zero)


def paired_rates(
    paired: DataFrame, keys: Sequence[str], slot: str, written: str, counters: Sequence[str], mode: str = "abs", drop_zero: bool = True
) -> DataFrame:
    """``counter_rate`` of samples that already carry ``before_<column>``, a table or a stream."""
    if mode not in ("abs", "reset_aware"):
        raise ValueError("mode is 'abs' or 'reset_aware'")
    seconds = F.unix_timestamp(F.col(written)) - F.unix_timestamp(F.col(f"before_{written}"))
    out: dict[str, Column] = {}
    any_usable = F.lit(False)
    for c in counters:
        now, before = F.col(c), F.col(f"before_{c}")
        value = S.rate(now, before, seconds)
        usable = ((now != 0) & (before != 0)) if drop_zero else F.lit(True)
        if mode == "reset_aware":
            out[f"{c}_reset"] = now < before
            usable = usable & (now >= before)
        out[f"{c}_rate"] = F.when(usable, value)
        any_usable = any_usable | usable
    if mode == "abs":
        paired = paired.filter(any_usable)
    return paired.select(*keys, slot, *[v.alias(k) for k, v in out.items()])


def no_result_markers(samples: DataFrame, rates: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Samples that have no rate, marked instead of counted as 0."""
    return samples.select(*keys, slot).join(rates.select(*keys, slot), [*keys, slot], "left_anti").withColumn(
        "marker", F.lit(NO_RESULT)
    )


def throughput(samples: DataFrame, keys: Sequence[str], slot: str, written: str, groups: Mapping[str, Sequence[str]], step_seconds: int = 60) -> DataFrame:
    """Named rates, each the sum of the rates of its counters, for example transactions = commits + rollbacks."""
    counters = list(dict.fromkeys(c for cs in groups.values() for c in cs))
    rates = counter_rate(samples, keys, slot, written, counters, step_seconds, drop_zero=False)
    named = [sum((F.col(f"{c}_rate") for c in cs[1:]), F.col(f"{cs[0]}_rate")).alias(n) for n, cs in groups.items()]
    return rates.select(*keys, slot, *named)


def busy_ratio(busy: Sequence[Column], idle: Column, digits: int = 2) -> Column:
    """Busy share of all time in percent; NULL when no time is counted."""
    work = sum(busy[1:], busy[0])
    return F.round(F.try_divide(work.cast("double") * 100, (work + idle).cast("double")), digits)


def load_breach(load: Column, cores: Column, percent: Column, cap: Column) -> Column:
    """Load above its share of the cores, or above the cap."""
    return breach(load, cores * percent / 100) | breach(load, cap)
