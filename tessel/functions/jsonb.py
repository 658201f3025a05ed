"""Operators on whole JSON documents. Nested documents have no built-in comparison in Spark, so these are Arrow-batched UDFs; for
flat objects the built-in recipes in `collections` are faster. Numbers are decimals with all their digits."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document_contains(a, b, top: bool = True) -> bool:
    """a @> b: objects by their members, arrays by any order of elements; an array also contains a bare scalar at the top."""
    if isinstance(a, dict):
        return isinstance(b, dict) and all(k in a and document_contains(a[k], v, False) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(document_contains(x, y, False) for x in a) for y in b)
        return top and not isinstance(b, dict) and any(same(x, b) for x in a)
    return not isinstance(b, (dict, list)) and same(a, b)


def same(a, b) -> bool:
    return order_key(a) == order_key(b)


def order_key(x) -> tuple:
    """Documents sort as null < string < number < boolean < array < object; an empty array before all; more elements later."""
    if isinstance(x, list):
        return (-1,) if not x else (4, len(x), tuple(order_key(y) for y in x))
    if isinstance(x, dict):
        names = sorted(x, key=lambda k: (len(k.encode()), k))
        return (5, len(x), tuple((k, order_key(x[k])) for k in names))
    if isinstance(x, bool):
        return (3, x)
    return (0,) if x is None else (1, x) if isinstance(x, str) else (2, x)


def merge(a, b):
    """a || b: objects by member, the right one winning; otherwise arrays end to end, others as arrays of one."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a | b
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def read(document: str):
    return json.loads(document, parse_float=Decimal, parse_int=Decimal)


def text(x) -> str:
    """As jsonb is shown: members by length and bytes of their names, a space after : and ,."""
    if isinstance(x, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {text(x[k])}" for k in sorted(x, key=lambda k: (len(k.encode()), k))) + "}"
    if isinstance(x, Decimal):
        return format(x if x else abs(x), "f")
    return "[" + ", ".join(map(text, x)) + "]" if isinstance(x, list) else json.dumps(x, ensure_ascii=False)


def _each(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else f(read(x), read(y)) for x, y in zip(a, b, strict=True)], dtype=object)


@F.pandas_udf(T.BooleanType())
def jsonb_contains(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(document_contains, a, b)


@F.pandas_udf(T.IntegerType())
def jsonb_compare(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, y: (order_key(x) > order_key(y)) - (order_key(x) < order_key(y)), a, b)


@F.pandas_udf(T.StringType())
def jsonb_concat(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, y: text(merge(x, y)), a, b)
