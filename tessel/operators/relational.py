"""Joins, subqueries, set-returning functions, recursion and aggregates where Spark has no operator with the meaning wanted."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where that is unset."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/tessel-work").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- subqueries


def any_quantifier(x: Column, op: str, stats: DataFrame) -> tuple[Column, Column]:
    """(x op ANY (subquery), x op ALL (subquery)) from a one-row table of mn, mx, n and nn (nulls) that is cross joined.

    The answer is unknown when only a null could decide it. = ANY and <> ALL need the rows themselves: see equals_any.
    """
    low, high = F.col("mn"), F.col("mx")
    if op in ("=", "<>"):  # of these only = ALL and <> ANY can be told from the extremes
        same = F.when(F.col("n") == 0, True).when(x.isNull(), F.lit(None).cast("boolean")).when((low != x) | (high != x), False).when(F.col("nn") > 0, F.lit(None).cast("boolean")).otherwise(True)
        return (F.lit(None).cast("boolean"), same) if op == "=" else (~same, F.lit(None).cast("boolean"))
    test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    easy, hard = (low, high) if op.startswith(">") else (high, low)
    unknown = F.lit(None).cast("boolean")
    some = F.when(F.col("n") == 0, False).when(x.isNull(), unknown).when(test(x, easy), True).when(F.col("nn") > 0, unknown).otherwise(False)
    every = F.when(F.col("n") == 0, True).when(x.isNull(), unknown).when(~test(x, hard), False).when(F.col("nn") > 0, unknown).otherwise(True)
    return some, every


def equals_any(outer: DataFrame, x: str, inner: DataFrame, column: str, name: str) -> DataFrame:
    """outer with name: x = ANY (SELECT column FROM inner); its negation is x <> ALL. One join on the distinct values, and a row
    of counts for emptiness and nulls."""
    stats = inner.agg(F.count("*").alias("__n"), (F.count("*") - F.count(column)).alias("__nn"))
    found = outer.join(inner.select(F.col(column).alias("__v")).where("__v is not null").distinct(), F.col(x) == F.col("__v"), "left").join(F.broadcast(stats))
    unknown = F.lit(None).cast("boolean")
    answer = F.when(F.col("__n") == 0, False).when(F.col(x).isNull(), unknown).when(F.col("__v").isNotNull(), True).when(F.col("__nn") > 0, unknown).otherwise(False)
    return found.withColumn(name, answer).drop("__v", "__n", "__nn")


def in_joined(outer: DataFrame, pair: tuple[str, str], left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """outer's rows with pair IN (SELECT x, y FROM left JOIN right ON u = v), left being (x, u), right (y, v) and on (u, v). The join
    can have as many rows as the product of its tables, so each row of outer asks for its own pair: an x's values of u, a y's of v.
    Those are merged with outer: a file of 10 MB can hold more of them than the driver could send to all."""
    (a, b), (u, v) = pair, on
    x, y = (next(c for c in df.columns if c != o) for df, o in ((left, u), (right, v)))
    us = left.groupBy(F.col(x).alias("__x")).agg(F.collect_set(u).alias("__us"))
    vs = right.groupBy(F.col(y).alias("__y")).agg(F.collect_set(v).alias("__vs"))
    found = outer.join(us.hint("merge"), F.col(a) == F.col("__x")).join(vs.hint("merge"), F.col(b) == F.col("__y"))
    return found.where(F.arrays_overlap("__us", "__vs")).select(*outer.columns)


def subquery_stats(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("mn"), F.max(column).alias("mx"), F.count("*").alias("n"), (F.count("*") - F.count(column)).alias("nn"))


def array_subquery(outer: DataFrame, inner: DataFrame, on: str, value: str, name: str) -> DataFrame:
    """ARRAY(SELECT value FROM inner WHERE inner.on = outer.on ORDER BY value): nulls kept, an empty array for no rows."""
    per_key = inner.groupBy(F.col(on).alias("__on")).agg(array_agg(F.col(value), F.col(value)).alias(name))
    kind = dict(per_key.dtypes)[name]
    return outer.join(per_key, outer[on] == F.col("__on"), "left").drop("__on").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


# ---------------------------------------------------------------- aggregates


@dataclass(frozen=True)
class Key:
    """A sort key inside an aggregate. Nulls come last, or first if descending, unless nulls_first says otherwise."""

    column: Column
    descending: bool = False
    nulls_first: bool | None = None


def _entry(x: Column, order: tuple[Column | Key, ...]) -> Column:
    """(null flag, key) of each sort key, then the value."""
    keys = [k if isinstance(k, Key) else Key(k) for k in order]
    flags = [k.column.isNotNull() if (k.descending if k.nulls_first is None else k.nulls_first) else k.column.isNull() for k in keys]
    return F.struct(*(c.alias(f"k{i}{n}") for i, (k, flag) in enumerate(zip(keys, flags, strict=True)) for n, c in (("n", flag), ("", k.column))), x.alias("x"))


def _in_order(whole: Column, order: tuple[Column | Key, ...]) -> Column:
    down = [isinstance(k, Key) and k.descending for k in order]
    if not any(down):
        return F.array_sort(whole) if order else whole

    def compare(a: Column, b: Column) -> Column:
        out = F.when(F.lit(False), 0)
        for i, desc in enumerate(down):
            out = out.when(a[f"k{i}n"] != b[f"k{i}n"], F.when(b[f"k{i}n"], -1).otherwise(1))
            less, more = (1, -1) if desc else (-1, 1)
            out = out.when(a[f"k{i}"] < b[f"k{i}"], less).when(a[f"k{i}"] > b[f"k{i}"], more)
        return out.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0)

    return F.array_sort(whole, compare)


def array_agg(x: Column, *order: Column | Key) -> Column:
    """Keeps nulls, orders by the given keys, is null for no rows; ties are ordered by the value."""
    return F.when(F.count(F.lit(1)) > 0, F.transform(_in_order(F.collect_list(_entry(x, order)), order), lambda s: s["x"]))


def string_agg(x: Column, delimiter: str, *order: Column | Key) -> Column:
    """Nulls are skipped; null if nothing is left."""
    whole = F.collect_list(F.when(x.isNotNull(), _entry(x, order)))
    return F.when(F.count(x) > 0, F.array_join(F.transform(_in_order(whole, order), lambda s: s["x"]), delimiter))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON (keys): the first row of each key. One aggregation with partial results, so a hot key is no window to sort."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


# ---------------------------------------------------------------- set-returning functions


def lockstep(df: DataFrame, **arrays: Column) -> DataFrame:
    """Several set-returning functions in one target list run side by side; short ones are padded with nulls, none gives no row."""
    named = df.withColumns({f"__{k}": v for k, v in arrays.items()})
    zipped = F.arrays_zip(*(F.coalesce(F.col(f"__{k}"), F.array()) for k in arrays))
    out = named.withColumn("__z", F.explode(zipped))
    return out.select(*df.columns, *(F.col("__z").getField(str(i)).alias(k) for i, k in enumerate(arrays)))


# ---------------------------------------------------------------- recursion


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000, every: int = 1, all_rows: bool = False) -> DataFrame:
    """WITH RECURSIVE by rounds: a step sees the rows that the last one added; UNION drops all rows seen before, UNION ALL none."""
    spark, root = seed.sparkSession, f"{shared_dir(seed.sparkSession)}/{uuid.uuid4().hex}"
    rows = seed if all_rows else seed.distinct()
    for n in range(rounds + 1):  # each round's rows are written once, to a folder of their own
        rows.write.parquet(f"{root}/{n}")
        fresh = spark.read.schema(seed.schema).parquet(f"{root}/{n}")
        if fresh.isEmpty():
            return spark.read.schema(seed.schema).parquet(*(f"{root}/{k}" for k in range(max(n, 1))))
        made = step(fresh)
        if not all_rows:
            done = spark.read.schema(seed.schema).parquet(*(f"{root}/{k}" for k in range(n + 1)))
            made = made.distinct().exceptAll(made.distinct().intersect(done))
        rows = made.select(*seed.columns)
    raise RuntimeError(f"recursion did not end within {rounds} rounds")


# ---------------------------------------------------------------- joins that Spark lacks


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time: one union, one window, no pairs.

    A hot key is cut into days first: each day is filled from its own rows, and from the last right row of earlier days.
    """
    day = lambda t: F.to_date(t)
    lrows = left.withColumn("__t", F.col(left_time)).withColumn("__side", F.lit(1))
    rrows = right.select(F.col(key), F.col(right_time).alias("__t"), F.struct(*values).alias("__v")).withColumn("__side", F.lit(0))
    both = lrows.withColumn("__v", F.lit(None).cast(rrows.schema["__v"].dataType)).unionByName(rrows, allowMissingColumns=True).withColumn("__day", day("__t"))
    inside = Window.partitionBy(key, "__day").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    last_of_day = rrows.groupBy(key, day("__t").alias("__day")).agg(F.max_by("__v", "__t").alias("__e"))
    days = both.select(key, "__day").distinct().join(last_of_day, [key, "__day"], "left")
    before = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = days.select(key, "__day", F.last("__e", ignorenulls=True).over(before).alias("__b"))
    filled = both.withColumn("__v", F.last("__v", ignorenulls=True).over(inside)).where("__side = 1").join(earlier, [key, "__day"], "left")
    return filled.withColumn("__v", F.coalesce("__v", "__b")).select(*left.columns, *(F.col(f"__v.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs with lo <= x < hi: ranges are listed under the buckets they touch, so it is an equality join with a filter."""
    p = points.withColumn("__bucket", F.floor(F.col(x) / width))
    r = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return p.join(r, "__bucket").where((F.col(lo) <= F.col(x)) & (F.col(x) < F.col(hi))).drop("__bucket")
