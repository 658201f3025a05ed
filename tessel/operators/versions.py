"""History queries over a version table: one row for each (key, commit) with a mark for deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(versions: DataFrame, key: list[str], at: Column, commit: str = "commit_ts", deleted: str = "deleted") -> DataFrame:
    """The newest version of each key at or before an instant, unless it is a deletion. One partial aggregation, no window."""
    rest = [c for c in versions.columns if c not in (*key, commit, deleted)]
    newest = versions.where(F.col(commit) <= at).groupBy(*key).agg(F.max_by(F.struct(*rest, deleted), F.col(commit)).alias("__v"))
    return newest.where(~F.col(f"__v.{deleted}")).select(*key, *(F.col(f"__v.{c}").alias(c) for c in rest))


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): inserted, deleted or updated between two states."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(*key, F.struct(*rest).alias("__a"))
    b = after.select(*key, F.struct(*rest).alias("__b"))
    change = F.when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "updated")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select(*key, "change")


def flashback(versions: DataFrame, key: list[str], at: Column, now: Column, commit: str = "commit_ts", deleted: str = "deleted") -> DataFrame:
    """The versions with new ones that bring the state at an instant back: changed or lost rows again, later rows as deletions."""
    rest = [c for c in versions.columns if c not in (*key, commit, deleted)]
    old, new = as_of(versions, key, at, commit, deleted), as_of(versions, key, now, commit, deleted)
    changes = diff(new, old, key)
    back = old.join(changes.where("change != 'deleted'"), key, "left_semi").withColumns({commit: now, deleted: F.lit(False)})
    gone = new.join(changes.where("change = 'deleted'"), key, "left_semi").withColumns({commit: now, deleted: F.lit(True)})
    return versions.unionByName(back.select(*versions.columns)).unionByName(gone.select(*versions.columns)).select(*key, *rest, commit, deleted)


def vacuum(versions: DataFrame, key: list[str], horizon: Column, commit: str = "commit_ts", deleted: str = "deleted") -> DataFrame:
    """Versions that a read at or after the horizon can still see."""
    newest = versions.where(F.col(commit) <= horizon).groupBy(*key).agg(F.max(commit).alias("__keep"))
    x = versions.join(newest, key, "left")
    return x.where(F.col("__keep").isNull() | (F.col(commit) > F.col("__keep")) | ((F.col(commit) == F.col("__keep")) & ~F.col(deleted))).drop("__keep")


class Checkpoints:
    """Named instants, kept as rows of a small table."""

    def __init__(self, spark):
        self.spark, self.names = spark, {}

    def create(self, name: str, at) -> None:
        if name in self.names:
            raise ValueError(f"checkpoint {name!r} exists")
        self.names[name] = at

    def drop(self, name: str) -> None:
        del self.names[name]

    def list(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.names.items()), "name string, commit_ts timestamp")

    def at(self, name: str) -> Column:
        return F.lit(self.names[name])
