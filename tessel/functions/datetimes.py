"""Dates and times with PostgreSQL meaning; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPARK_UNITS = {"microseconds": "microsecond", "milliseconds": "millisecond", "second": "second", "minute": "minute", "hour": "hour", "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}
_YEARS = {"decade": (10, 0), "century": (100, 1), "millennium": (1000, 1)}


def date_trunc(unit: str, ts: Column) -> Column:
    """All thirteen units; decades start at years divisible by ten, centuries and millennia at year one (Spark gives null for these three)."""
    unit = unit.lower()
    if unit in _SPARK_UNITS:
        return F.date_trunc(_SPARK_UNITS[unit], ts)
    if unit not in _YEARS:
        raise ValueError(f"unit {unit!r} not recognized")
    size, first = _YEARS[unit]
    year = (F.floor((F.year(ts) - first) / size) * size + first).cast("int")
    return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")


def days_between(a: Column, b: Column) -> Column:
    """date - date is a number of days (Spark gives an interval)."""
    return F.datediff(a, b)


def add_days(d: Column, n: Column | int) -> Column:
    return F.date_add(d, n)


def seconds_between(a: Column, b: Column) -> Column:
    """timestamp - timestamp in seconds, with fractions."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


def add_interval(ts: Column, months: int = 0, days: int = 0, seconds: int = 0) -> Column:
    """Months first (clipped to the month's end), then days, then time, as an interval's three parts are applied."""
    return ts + F.make_interval(F.lit(0), F.lit(months), F.lit(0), F.lit(days), F.lit(0), F.lit(0), F.lit(seconds))


def time_of_day(ts: Column) -> Column:
    """Microseconds since midnight, for LOCALTIME and the type time."""
    return F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))


def trunc_in_zone(unit: str, ts: Column, zone: str) -> Column:
    """date_trunc(unit, timestamptz, zone): cut off by the zone's clock (Spark knows the session's zone only)."""
    return F.to_utc_timestamp(date_trunc(unit, F.from_utc_timestamp(ts, zone)), zone)


def at_time_zone(ts: Column, zone: str) -> Column:
    """timestamptz AT TIME ZONE: what the zone's clock shows."""
    return F.from_utc_timestamp(ts, zone)


# An interval is struct<months int, days int, micros bigint>: its three parts are kept and added apart.


def interval(months: Column | int = 0, days: Column | int = 0, micros: Column | int = 0) -> Column:
    part = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(part(months, "int").alias("months"), part(days, "int").alias("days"), part(micros, "bigint").alias("micros"))


def interval_times(i: Column, n: Column | int) -> Column:
    return interval(i["months"] * n, i["days"] * n, i["micros"] * n)


def interval_plus(a: Column, b: Column, sign: int = 1) -> Column:
    return interval(a["months"] + sign * b["months"], a["days"] + sign * b["days"], a["micros"] + sign * b["micros"])


def add(ts: Column, i: Column) -> Column:
    """timestamp + interval: months, then days, then time."""
    whole = ts + F.make_interval(F.lit(0), i["months"], F.lit(0), i["days"])
    return F.timestamp_micros(F.unix_micros(whole) + i["micros"])


_MICROS = {"microseconds": 1, "milliseconds": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12_000}


def interval_trunc(unit: str, i: Column) -> Column:
    """date_trunc(unit, interval): smaller parts become zero; there are no weeks in an interval."""
    unit = unit.lower()
    if unit in _MICROS:
        return interval(i["months"], i["days"], i["micros"] - i["micros"] % _MICROS[unit])
    if unit == "day":
        return interval(i["months"], i["days"])
    if unit in _MONTHS:
        return interval(i["months"] - i["months"] % _MONTHS[unit])
    raise ValueError(f"unit {unit!r} not supported for type interval")


def interval_sum(i: Column) -> Column:
    """sum(interval): part by part."""
    return F.struct(*(F.sum(i[p]).cast(k).alias(p) for p, k in (("months", "int"), ("days", "int"), ("micros", "bigint"))))


def interval_text(i: Column) -> Column:
    """As an interval is shown: years and months, days, then hours:minutes:seconds."""
    plural = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {unit}")).otherwise(F.lit(f" {unit}s"))))
    m, us = i["months"], F.abs(i["micros"])
    years, months = F.call_function("div", m, F.lit(12)).cast("int"), (m % 12).cast("int")
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.lit(2), F.char_length(x.cast("string"))), F.lit("0"))
    part = lambda by: F.call_function("div", us, F.lit(by))
    clock = F.concat(F.when(i["micros"] < 0, F.lit("-")).otherwise(F.lit("")), two(part(3_600_000_000)), F.lit(":"), two(part(60_000_000) % 60), F.lit(":"), two(part(1_000_000) % 60), F.regexp_replace(F.concat(F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0")), r"\.?0+$", ""))
    rest = F.when((i["micros"] != 0) | ((m == 0) & (i["days"] == 0)), clock)
    return F.concat_ws(" ", plural(years, "year"), plural(months, "mon"), plural(i["days"], "day"), rest)
