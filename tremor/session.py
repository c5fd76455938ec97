"""A session with the settings that results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **more: str) -> SparkSession:
    """Partitions are Spark's to choose, or the caller's."""
    b = SparkSession.builder.master(master).appName("tremor")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | more).items():
        b = b.config(k, v)
    return b.getOrCreate()
