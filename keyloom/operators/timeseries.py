"""Operators on time series: ``kv_ts (key, ts, value)`` with ts in milliseconds, and ``kv_ts_meta (key, labels)``.

Buckets begin at multiples of their width. Of several samples at one time the
last written counts: ``latest`` keeps it where a log has ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .strings import last_write


def _by() -> WindowSpec:
    return Window.partitionBy("key")



def _of(name: str) -> Column:
    v, at = F.col("value"), F.col("ts")
    return {
        "avg": lambda: F.avg(v),
        "sum": lambda: F.sum(v),
        "count": lambda: F.count(v).cast("double"),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "first": lambda: F.min_by(v, at),
        "last": lambda: F.max_by(v, at),
        "range": lambda: F.max(v) - F.min(v),
        "std.p": lambda: F.stddev_pop(v),
        "std.s": lambda: F.coalesce(F.stddev_samp(v), F.lit(0.0)),
        "var.p": lambda: F.var_pop(v),
        "var.s": lambda: F.coalesce(F.var_samp(v), F.lit(0.0)),
    }[name]()


#: Names of the bucket functions; sample variance and deviation of one value are 0.
AGGREGATIONS = ("avg", "sum", "count", "min", "max", "first", "last", "range", "std.p", "std.s", "var.p", "var.s")


def latest(log: DataFrame) -> DataFrame:
    """One sample for each (key, ts): the last written."""
    return last_write(log, "key", "ts").select("key", "ts", "value")


def bucket(width: int) -> Column:
    if width <= 0:
        raise ValueError("a bucket has a positive width")
    return (F.floor(F.col("ts") / width) * width).cast("long")


def between(table: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    if start is not None:
        table = table.where(F.col("ts") >= start)
    return table if stop is None else table.where(F.col("ts") <= stop)


def ts_range(table: DataFrame, start: int | None = None, stop: int | None = None, aggregation: str | None = None, width: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
    """Samples, or one value for each bucket, of a time range of each key; ``count`` keeps the first or last ones."""
    rows = between(table, start, stop).select("key", "ts", "value")
    if aggregation is not None:
        rows = rows.groupBy("key", bucket(width).alias("bucket")).agg(_of(aggregation).alias("value")).withColumnRenamed("bucket", "ts")
    if count is None:
        return rows
    order = _by().orderBy(F.col("ts").desc() if reverse else F.col("ts"), "value")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def label_filter(meta: DataFrame, filters: list[str]) -> DataFrame:
    """Series whose labels fit all of ``name=value``, ``name!=value`` (an absent label is no value)."""
    for f in filters:
        name, sign, value = f.partition("!=") if "!=" in f else f.partition("=")
        if not sign:
            raise ValueError(f"no filter: {f}")
        label = F.col("labels")[name]
        meta = meta.where(label == value) if sign == "=" else meta.where(label.isNull() | (label != value))
    return meta


def query_index(meta: DataFrame, filters: list[str]) -> DataFrame:
    return label_filter(meta, filters).select("key")


def mrange(table: DataFrame, meta: DataFrame, filters: list[str], start: int | None = None, stop: int | None = None, aggregation: str | None = None, width: int = 0, count: int | None = None, reverse: bool = False) -> DataFrame:
    """``ts_range`` over all series whose labels fit."""
    return ts_range(table.join(query_index(meta, filters), "key", "left_semi"), start, stop, aggregation, width, count, reverse)


def ts_get(table: DataFrame) -> DataFrame:
    """Last sample of each key."""
    return table.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("_x")).select("key", "_x.ts", "_x.value")


def mget(table: DataFrame, meta: DataFrame, filters: list[str]) -> DataFrame:
    return ts_get(table.join(query_index(meta, filters), "key", "left_semi"))


def incrby(log: DataFrame) -> DataFrame:
    """Samples of a log of changes (key, ts, seq, delta): the running sum of each key."""
    w = _by().orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.select("key", "ts", "seq", F.sum("delta").over(w).alias("value"))


def ts_del(table: DataFrame, start: int, stop: int) -> DataFrame:
    """The table without a time range (both ends go)."""
    return table.where(~F.col("ts").between(start, stop))


def retain(table: DataFrame, meta: DataFrame, now: int) -> DataFrame:
    """Samples not older than the retention of their key (``retention_ms``, 0 for no end)."""
    j = table.join(meta.select("key", "retention_ms"), "key", "left")
    keep = F.col("retention_ms").isNull() | (F.col("retention_ms") == 0) | (F.col("ts") >= now - F.col("retention_ms"))
    return j.where(keep).drop("retention_ms")


def info(table: DataFrame) -> DataFrame:
    n = F.count("*")
    return table.groupBy("key").agg(n.alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.ceil(n / 256).cast("long").alias("chunks"))


def downsample(table: DataFrame, aggregation: str, width: int, suffix: str) -> DataFrame:
    """A series of buckets for each key, under the key with a suffix."""
    return ts_range(table, aggregation=aggregation, width=width).withColumn("key", F.concat(F.col("key").cast("string"), F.lit(suffix)))
