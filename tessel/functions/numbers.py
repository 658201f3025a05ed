"""Arithmetic with PostgreSQL meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Integer division truncates toward zero (Spark's / gives a double)."""
    return F.call_function("div", a, b)


def remainder(a: Column, b: Column) -> Column:
    """Sign of the dividend."""
    return a % b


def power(a: Column, b: Column) -> Column:
    """^ is power, not exclusive or."""
    return F.pow(a, b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(a, n)


def to_integer(x: Column, kind: str = "bigint") -> Column:
    """A cast from numeric rounds half away from zero (Spark's cast cuts off)."""
    return F.round(x.cast("decimal(38,10)"), 0).cast(kind)


def float_to_integer(x: Column, kind: str = "bigint") -> Column:
    """A cast from double precision rounds half to even."""
    return F.rint(x).cast(kind)


def wide_sum(x: Column) -> Column:
    """sum(bigint) is numeric and doesn't overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def exact_avg(x: Column) -> Column:
    """avg of integers is numeric: exact sum over count."""
    return F.sum(x.cast("decimal(28,0)")) / F.count(x).cast("decimal(20,0)")


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)
