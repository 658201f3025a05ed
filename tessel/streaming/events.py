"""Structured Streaming over the events table, and the learner that applies a change log to versioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.tables import zoned


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A file stream; path is a folder or a glob of Parquet files."""
    return zoned(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def distinct(events: DataFrame, columns: list[str]) -> DataFrame:
    """Whatever the files' order and however far apart the repeats: every key is kept as state, so for bounded reads."""
    return events.select(*columns).dropDuplicates(columns)


def without_repeats(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """For unbounded streams: rows older than the watermark are dropped, and repeats further apart than late stay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the streaming engine, into Parquet files of the folder, never through the driver.

    In append mode each micro-batch is a part of its own, written anew if it is tried again. In complete mode a batch is the
    whole result so far, so only the last one is read.
    """
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        done.append(number)

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark = df.sparkSession
    paths = [f"{folder}/rows/batch={n}" for n in (sorted(set(done)) if mode == "append" else done[-1:])]
    return spark.read.schema(df.schema).parquet(*paths) if paths else spark.createDataFrame([], df.schema)


def apply_changes(changes: DataFrame, path: str, checkpoint: str):
    """The learner: each micro-batch of (key, value, commit_ts, deleted) becomes a run of versions. A batch that is tried again
    overwrites its own run, so every change is applied once; readers merge the runs."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
