"""Operators on hashes: table ``kv_hash (key, field, value)`` with an optional ``field_expire_at``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches
from .strings import first_write, last_write


def hset(log: DataFrame) -> DataFrame:
    """Last write of each (key, field) of a log with ``seq``."""
    return last_write(log, "key", "field")


def hsetnx(log: DataFrame) -> DataFrame:
    """First write of each (key, field)."""
    return first_write(log, "key", "field")


def hget(table: DataFrame, key: str, field: str) -> DataFrame:
    return table.where((F.col("key") == key) & (F.col("field") == field)).select("value")


def hmget(table: DataFrame, fields: list[str]) -> DataFrame:
    """For every key the values of the fields, in the order asked (``values``, null where absent)."""
    cols = [F.max(F.when(F.col("field") == f, F.col("value"))) for f in fields]
    return table.groupBy("key").agg(F.array(*cols).alias("values"))


def hgetall(table: DataFrame) -> DataFrame:
    """``key`` and ``fields``, a map."""
    return table.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hkeys(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def hvals(table: DataFrame) -> DataFrame:
    """Values of each key in the order of their fields."""
    return table.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "value"))), lambda x: x["value"]).alias("values"))


def hlen(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def hexists(table: DataFrame, field: str) -> DataFrame:
    return table.groupBy("key").agg(F.max((F.col("field") == field).cast("int")).alias("found"))


def hstrlen(table: DataFrame) -> DataFrame:
    return table.select("key", "field", F.octet_length(F.col("value").cast("string")).cast("long").alias("length"))


def hdel(table: DataFrame, names: DataFrame) -> DataFrame:
    """The table without these (key, field); a key without fields is gone with them."""
    return table.join(names.select("key", "field").distinct(), ["key", "field"], "left_anti")


def hincrby(log: DataFrame, delta: str = "delta") -> DataFrame:
    """Sum of the changes of each (key, field), whole numbers or not."""
    return log.groupBy("key", "field").agg(F.sum(delta).alias("value"))


def hrandfield(table: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """So many different fields of each key by a seeded hash; a negative count draws with repetition."""
    if count >= 0:
        w = Window.partitionBy("key").orderBy(F.xxhash64("field", F.lit(seed)), "field")
        return table.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n")
    numbered = table.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("field")))
    draws = table.groupBy("key").agg(F.count("*").alias("_size")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-count))))
    draws = draws.withColumn("_n", (F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("_size")) + 1).cast("int"))
    return draws.join(numbered, ["key", "_n"]).drop("_n", "_size")


def hscan(table: DataFrame, pattern: str) -> DataFrame:
    """Fields that match a glob, with their values."""
    return table.where(matches(F.col("field"), pattern)).select("key", "field", "value")


def live_fields(table: DataFrame, now: Column) -> DataFrame:
    return table.where(F.col("field_expire_at").isNull() | (F.col("field_expire_at") > now))


def hexpire(table: DataFrame, names: DataFrame, at: Column) -> DataFrame:
    """Deadline ``at`` on these (key, field) (HGETEX, HSETEX); a null one is HPERSIST."""
    hit = names.select("key", "field").distinct().withColumn("_hit", F.lit(True))
    put = F.when(F.col("_hit"), at).otherwise(F.col("field_expire_at"))
    return table.join(hit, ["key", "field"], "left").withColumn("field_expire_at", put).drop("_hit")


def httl(table: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """``ttl`` (seconds, cut) and ``pttl`` of each (key, field): -2 without the field, -1 without a deadline."""
    j = names.select("key", "field").join(table.select("key", "field", "field_expire_at", F.lit(True).alias("_there")), ["key", "field"], "left")
    left = F.unix_millis("field_expire_at") - F.unix_millis(now)

    def of(x: Column) -> Column:
        return F.when(F.col("_there").isNull(), -2).when(F.col("field_expire_at").isNull(), -1).otherwise(x).cast("long")

    return j.select("key", "field", of(F.floor(left / 1000)).alias("ttl"), of(left).alias("pttl"))


def hgetdel(table: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values of these (key, field), and the table without them."""
    return table.join(names.select("key", "field").distinct(), ["key", "field"], "left_semi"), hdel(table, names)
