"""Session settings the recipes rely on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: ANSI arithmetic errors, UTC, and the last of two equal map keys are part of the results' meaning.
SEMANTICS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it; a cluster has it installed or sent with the job."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A single-node session; on a cluster take the cluster's own session and apply SEMANTICS."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("tessel")
    settings = SEMANTICS | {
        "spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
