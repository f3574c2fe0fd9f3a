"""Spark session with the settings this library is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session in UTC with ANSI mode and adaptive execution on; on a cluster leave ``shuffle_partitions`` to its settings."""
    builder = SparkSession.builder.master(master).config(map={**SETTINGS, **more})
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
