"""Users and permissions as tables: which commands on which keys a user may run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_to_regex


def allowed(log: DataFrame, user: str, commands: list[str], patterns: list[str]) -> DataFrame:
    """Rows of a command log (user, cmd, key) with ``ok``: false for a user's commands or keys outside the lists (``*``: all)."""
    cmd: Column = F.lit(True) if "*" in commands else F.lower("cmd").isin([c.lower() for c in commands])
    key: Column = F.lit(False)
    for p in patterns:
        key = key | F.col("key").rlike(glob_to_regex(p))
    return log.withColumn("ok", F.when(F.col("user") == user, cmd & key).otherwise(F.lit(True)))


def refused(log: DataFrame) -> DataFrame:
    """Number of refused commands by user and command."""
    return log.where(~F.col("ok")).groupBy("user", "cmd").agg(F.count("*").alias("n"))
