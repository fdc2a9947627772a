"""Tables from Parquet and the keyed views of them that the operators take."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write(df: DataFrame, path: str, key: str | None = "key", mode: str = "overwrite") -> None:
    """Parquet, sorted by key within its files so that point reads and ranges skip row groups."""
    (df.sortWithinPartitions(key) if key else df).write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "key") -> None:
    """A table bucketed and sorted by key: joins and aggregates by key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that ``spark.checkpoint.dir`` names; a temporary one on a local master where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}" if base else f"{tempfile.mkdtemp(prefix='keyloom-')}/{name}"


def zset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of customers by nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of order totals of each customer (score) by order status, as whole cents."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("key"), F.col("o_custkey").cast("string").alias("member")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("score"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by order status."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member")).distinct()


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as writes: key, field, value and seq."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_orderkey").alias("seq"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each order in order of their lines."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("key"), F.row_number().over(w).cast("long").alias("pos"), F.col("l_partkey").alias("value"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values by user; ts in milliseconds, seq the event."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "value", F.col("event_id").alias("seq"), "event_type")


def series_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each user's series: its most frequent event type and a shard."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), "event_type").agg(F.count("*").alias("n"))
    top = e.groupBy("key").agg(F.max(F.struct("n", "event_type")).alias("x"))
    return top.select("key", F.create_map(F.lit("type"), F.col("x.event_type"), F.lit("shard"), (F.col("key") % 4).cast("string")).alias("labels"), F.lit(7 * 86_400_000).cast("long").alias("retention_ms"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, with an id within their millisecond."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("event_type", ms).orderBy("event_id")
    return e.select(F.col("event_type").alias("key"), ms.alias("ms"), (F.row_number().over(w) - 1).cast("long").alias("seq"), "user_id", "value", "event_id")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each event by arithmetic on its id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("member"), ((F.col("event_id") * 7919 % 36000) / 100.0 - 180).alias("lon"), ((F.col("event_id") * 104729 % 17000) / 100.0 - 85).alias("lat"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("props").alias("doc"))
