"""A session with the settings that the operators are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, so that times are the same everywhere; adaptive plans split skewed joins and merge small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; names in ``more`` have _ for dots."""
    b = SparkSession.builder.appName("keyloom")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
