"""Runs a query's Spark plan and its DuckDB SQL on the same files and compares names, kinds and rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return sorted((str(k), plain(v)) for k, v in x.items())
    return x.isoformat() if isinstance(x, datetime.date) else x


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def kind(x: str) -> str:
    x = x.lower()
    for names, out in (("bigint hugeint long", "int64"), ("integer int", "int32"), ("varchar string", "text"), ("double", "double"), ("float", "float"), ("boolean", "bool"), ("timestamp", "timestamp"), ("date", "date")):
        if x.split("(")[0] in names.split():
            return out
    return x.replace("array<", "").replace(">", "[]").replace("string", "varchar").replace("int", "integer") if "array<" in x else x.replace("varchar", "varchar")


def differences(df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    names, kinds = [d[0] for d in found.description], [str(d[1]) for d in found.description]
    want, got = rows_of(names, found.fetchall()), rows_of(df.columns, df.collect())
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"names {sorted(df.columns)} and {sorted(names)}"]
    theirs = dict(zip(names, kinds, strict=True))
    out += [f"{c}: {k} and {theirs[c]}" for c, k in df.dtypes if kind(k) != kind(theirs[c]) and "[]" not in theirs[c]]
    if len(want) != len(got):
        out.append(f"{len(got)} and {len(want)} rows")
    elif want != got:
        k = next(i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b)
        out.append(f"{sum(a != b for a, b in zip(got, want, strict=True))} rows differ, such as {got[k]} and {want[k]}")
    return out
