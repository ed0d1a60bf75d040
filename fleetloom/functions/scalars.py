"""Column helpers: numbers, times, names, text. All are built-in expressions, none is a Python function per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_TIME = "1970-01-01 00:00:00"

# Full-width punctuation and its ASCII form, pair by pair.
FULL_WIDTH = "，。？！：；（）【】“”‘’、"
HALF_WIDTH = ",.?!:;()[]\"\"'',"

# Parts of a sharded table name and the date pattern each stands for.
SHARD_PARTS = {"#yyyy#": "yyyy", "#mmdd#": "MMdd", "#mm#": "MM"}
SHARD_DIGITS = {"#yyyy#": "[0-9]{4}", "#mmdd#": "[0-9]{4}", "#mm#": "[0-9]{2}"}


def rate(now: Column, before: Column, seconds: Column) -> Column:
    """Rounded absolute change per second; NULL when no time has passed."""
    return F.round(F.abs(F.try_divide((now - before).cast("double"), seconds.cast("double"))))


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def to_epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def compact_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def minus_minutes(ts: Column, n: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(n)} MINUTES")


def minus_days(ts: Column, n: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(n)} DAYS")


def plus_days(day: Column, n: int) -> Column:
    return F.date_add(day, n)


def plus_months(day: Column, n: int) -> Column:
    return F.add_months(day, n)


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock_to_second(text: Column) -> Column:
    """Seconds since midnight of ``HH:mm:ss``."""
    part = F.split(text, ":")
    return (
        part.getItem(0).try_cast("int") * 3600 + part.getItem(1).try_cast("int") * 60 + part.getItem(2).try_cast("int")
    )


def weekday_number(day: Column) -> Column:
    """0 is Sunday, 6 is Saturday."""
    return F.dayofweek(day) - 1


def day_in_week(day: Column, weekday: Column | int) -> Column:
    """Date of ``weekday`` (0 Sunday) counted on from the Sunday that closes the Monday-based week of ``day``."""
    sunday = F.next_day(F.date_sub(day, 1), "SU")
    return F.date_add(sunday, weekday if isinstance(weekday, Column) else F.lit(weekday))


def lenient_time(text: Column, *patterns: str) -> Column:
    """First pattern that fits, else NULL; the stored 'unknown' time is NULL too."""
    tries = [F.try_to_timestamp(text, F.lit(p)) for p in (patterns or ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"))]
    found = F.coalesce(*tries)
    return F.nullif(found, F.lit(UNKNOWN_TIME).cast("timestamp"))


def lenient_epoch(text: Column) -> Column:
    """Epoch seconds of a time text, 0 when it cannot be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0))


def is_date(text: Column, pattern: str = "yyyyMMdd") -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).isNotNull()


def name_part(text: Column, index: int, sep: str = ".") -> Column:
    """Part ``index`` (from 1, negative from the end) of a separated name; NULL when absent."""
    return F.try_element_at(F.split(text, f"\\Q{sep}\\E"), F.lit(index))


def join_parts(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *parts)


def flatten_name(text: Column, by: str = "_") -> Column:
    """Dots replaced, quotes and backticks dropped, lower case."""
    return F.lower(F.translate(F.replace(text, F.lit("."), F.lit(by)), "`'\"", ""))


def drop_auto_increment(ddl: Column) -> Column:
    return F.regexp_replace(ddl, r"AUTO_INCREMENT=[0-9]+ ?", "")


def match_start(text: Column, pattern: str) -> Column:
    """1-based position of the first match, 0 when there is none."""
    return F.regexp_instr(text, F.lit(pattern))


def map_chars(text: Column, source: str, target: str) -> Column:
    """Characters of ``source`` become those of ``target``; the ones without a partner are deleted."""
    return F.translate(text, source, target)


def normalise_punctuation(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def fill_template(template: Column, day: Column) -> Column:
    """Shard name of ``day`` from a template with ``#yyyy#``, ``#mmdd#``, ``#mm#``."""
    for mark, pattern in SHARD_PARTS.items():
        template = F.replace(template, F.lit(mark), F.date_format(day, pattern))
    return template


def instance_task_id(host: Column, port: Column, ts: Column) -> Column:
    """Host without dots, port and compact time, joined by underscores."""
    return F.concat_ws("_", F.replace(host, F.lit("."), F.lit("")), port.cast("string"), compact_time(ts))


def run_task_id(kind: Column, day: Column, mode: Column) -> Column:
    return F.upper(F.concat_ws("-", kind, compact_date(day), mode))


def percent_to_number(text: Column) -> Column:
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double")


def text_length(text: Column) -> Column:
    return F.length(text)


def text_bytes(text: Column) -> Column:
    return F.octet_length(text)


def bounded_number(seed: Column, low: int, high: int) -> Column:
    """Whole number in ``low..high``, fixed by the seed."""
    return F.pmod(seed.cast("long"), F.lit(high - low + 1)) + F.lit(low)


def spread_number(key: Column, low: int, high: int) -> Column:
    return bounded_number(F.xxhash64(key), low, high)


def dict_text_to_struct(text: Column, schema: str) -> Column:
    """Struct from ``{u'a': 'x', 'n': 10000L}``: unicode marks and long marks are dropped first."""
    plain = F.regexp_replace(text, r"([{\s,:\[])u(['\"])", r"$1$2")
    plain = F.regexp_replace(plain, r"(:\s*-?[0-9]+)L", "$1")
    return F.from_json(plain, schema, {"allowSingleQuotes": "true"})


def is_number(text: Column) -> Column:
    return F.trim(text).try_cast("double").isNotNull()


def to_sorted_json(fields: dict[str, Column]) -> Column:
    """JSON text of the fields in key order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def range_text(text: Column) -> Column:
    """Struct of two seconds of day from ``00:00:01-01:00:01``."""
    part = F.split(text, "-")
    return F.struct(clock_to_second(part.getItem(0)).alias("start_sec"), clock_to_second(part.getItem(1)).alias("end_sec"))


def comma_list(text: Column) -> Column:
    """``a, b`` as an array of trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def host_port(text: Column) -> Column:
    """Struct of host and port from ``host:port``."""
    return F.struct(name_part(text, 1, ":").alias("host"), name_part(text, 2, ":").try_cast("int").alias("port"))


def wall_clock(utc: Column, zone: str) -> Column:
    """Local wall-clock time of a UTC time, to compare the two kinds of columns in a row."""
    return F.from_utc_timestamp(utc, zone)


def rule_array(text: Column) -> Column:
    """``0-7-365`` as an array of whole numbers."""
    return F.transform(F.split(text, "-"), lambda p: p.try_cast("int"))
