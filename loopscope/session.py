"""A session with the settings that the plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Semantics first (UTC, ANSI), then what lets Spark plan at run time: splits of skewed joins, merged small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """The active session, or a new one; on a cluster leave master and shuffle_partitions to spark-submit."""
    b = SparkSession.builder.appName("loopscope")
    if master:
        b = b.master(master)
        b = b.config("spark.driver.memory", os.environ.get("LOOPSCOPE_DRIVER_MEMORY", "6g")).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
