"""Operators on sets: table ``kv_set (key, member)`` without repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches


def sadd(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.select("key", "member").union(rows.select("key", "member")).distinct()


def srem(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select("key", "member"), ["key", "member"], "left_anti")


def smismember(table: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """``member`` and ``found`` (0 or 1) for each member asked."""
    own = table.where(F.col("key") == key).select("member", F.lit(1).alias("_there"))
    return members.select("member").join(own, "member", "left").select("member", F.coalesce("_there", F.lit(0)).alias("found"))


def scard(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def smembers(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("key") == key).select("member")


def sinter(table: DataFrame, keys: list[str]) -> DataFrame:
    """Members of all these sets: one aggregate instead of a join for each set; empty where a set is missing."""
    keys = list(dict.fromkeys(keys))
    return table.where(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("_n")).where(F.col("_n") == len(keys)).select("member")


def sunion(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.where(F.col("key").isin(keys)).select("member").distinct()


def sdiff(table: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first set that no other has."""
    first, rest = keys[0], keys[1:]
    if first in rest:
        return table.limit(0).select("member")
    own = table.where(F.col("key").isin(keys)).groupBy("member").agg(F.min(F.col("key") == first).alias("_only"))
    return own.where("_only").select("member")


def stored(table: DataFrame, target: str, members: DataFrame) -> DataFrame:
    """The table with a set put in place of ``target`` (SINTERSTORE, SUNIONSTORE, SDIFFSTORE)."""
    return table.where(F.col("key") != target).select("key", "member").union(members.select(F.lit(target), "member"))


def sintercard(table: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    """Size of the intersection, at most ``limit`` where it is above 0."""
    n = F.count("*")
    return sinter(table, keys).agg((F.least(n, F.lit(limit)) if limit > 0 else n).alias("n"))


def srandmember(table: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """So many different members of each set by a seeded hash; a negative count draws with repetition."""
    if count >= 0:
        w = Window.partitionBy("key").orderBy(F.xxhash64("member", F.lit(seed)), "member")
        return table.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= count).drop("_n")
    numbered = table.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("member")))
    draws = table.groupBy("key").agg(F.count("*").alias("_size")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-count))))
    draws = draws.withColumn("_n", (F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("_size")) + 1).cast("int"))
    return draws.join(numbered, ["key", "_n"]).select("key", "draw", "member")


def spop(table: DataFrame, count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Members taken by a seeded hash, and what is left."""
    taken = srandmember(table, count, seed)
    return taken, srem(table, taken)


def sscan(table: DataFrame, pattern: str) -> DataFrame:
    return table.where(matches(F.col("member").cast("string"), pattern)).select("key", "member")


def smove(table: DataFrame, source: str, target: str, member) -> DataFrame:
    """The table with a member moved from one set to another, where the first has it."""
    hit = (F.col("key") == source) & (F.col("member") == F.lit(member))
    return table.select(F.when(hit, target).otherwise(F.col("key")).alias("key"), "member").distinct()
