"""Operators on lists: table ``kv_list (key, pos, value)``; ``pos`` orders a list and need not be dense.

Positions are numbered with windows by key, so one list is ordered within
one task, which may spill; lists of different keys run in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import clamp_range


def _by() -> WindowSpec:
    return Window.partitionBy("key")


def _head() -> WindowSpec:
    return _by().orderBy("pos")


def _tail() -> WindowSpec:
    return _by().orderBy(F.col("pos").desc())


def push(table: DataFrame, rows: DataFrame, left: bool = False, only_existing: bool = False) -> DataFrame:
    """The table with rows (key, seq, value) added one by one at the tail, or at the head.

    Places beyond the ends of each list continue its numbers. With
    ``only_existing`` rows of keys without a list are dropped (LPUSHX, RPUSHX).
    """
    ends = table.groupBy("key").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    n = F.row_number().over(_by().orderBy("seq"))
    rows = rows.select("key", n.alias("_n"), "value").join(ends, "key", "inner" if only_existing else "left")
    pos = F.coalesce(F.col("_lo"), F.lit(0)) - F.col("_n") if left else F.coalesce(F.col("_hi"), F.lit(-1)) + F.col("_n")
    return table.select("key", "pos", "value").unionByName(rows.select("key", pos.cast("long").alias("pos"), "value"))


def from_log(log: DataFrame) -> DataFrame:
    """Lists from a log (key, seq, side, value) of pushes to the sides ``left`` and ``right``."""
    return log.select("key", F.when(F.col("side") == "left", -F.col("seq")).otherwise(F.col("seq")).cast("long").alias("pos"), "value")


def indexed(table: DataFrame) -> DataFrame:
    """The table with ``i``, the index from 0, and ``n``, the length of the list."""
    return table.withColumn("i", (F.row_number().over(_head()) - 1).cast("long")).withColumn("n", F.count("*").over(_by()))


def pop(table: DataFrame, count: int = 1, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is popped from each list, in order, and what is left."""
    marked = table.withColumn("_n", F.row_number().over(_tail() if right else _head()))
    return marked.where(F.col("_n") <= count).withColumnRenamed("_n", "rank"), marked.where(F.col("_n") > count).drop("_n")


def llen(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def lindex(table: DataFrame, index: int) -> DataFrame:
    """The element at an index of each list, negative from its end; lists without it give no row."""
    at = F.row_number().over(_tail() if index < 0 else _head())
    return table.withColumn("_n", at).where(F.col("_n") == (-index if index < 0 else index + 1)).select("key", "value")


def lrange(table: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements start..stop of each list (inclusive, negative from the end), with their index."""
    first, size = clamp_range(F.col("n"), start, stop)
    return indexed(table).where((F.col("i") >= first) & (F.col("i") < first + size)).select("key", "pos", "i", "value")


def ltrim(table: DataFrame, start: int, stop: int) -> DataFrame:
    """The table with only start..stop of each list left."""
    return lrange(table, start, stop).select("key", "pos", "value")


def lset(table: DataFrame, index: int, value) -> DataFrame:
    """The table with the element at an index replaced, where there is one."""
    hit = F.col("i") == (F.col("n") + index if index < 0 else F.lit(index))
    return indexed(table).select("key", "pos", F.when(hit, F.lit(value)).otherwise(F.col("value")).alias("value"))


def lrem(table: DataFrame, count: int, value) -> DataFrame:
    """The table without the first (count > 0), last (< 0) or all (0) elements equal to a value."""
    w = Window.partitionBy("key", F.col("value") == F.lit(value)).orderBy(F.col("pos").desc() if count < 0 else F.col("pos"))
    gone = (F.col("value") == F.lit(value)) & (F.lit(True) if count == 0 else F.col("_n") <= abs(count))
    return table.withColumn("_n", F.row_number().over(w)).where(~F.coalesce(gone, F.lit(False))).drop("_n")


def linsert(table: DataFrame, pivot, value, after: bool = False) -> DataFrame:
    """Lists (key, i, value) with a value put before or after the first pivot of each that has one."""
    i = table.select("key", (F.row_number().over(_head()) - 1).cast("long").alias("i"), "value")
    rows = i.withColumn("_at", F.min(F.when(F.col("value") == F.lit(pivot), F.col("i"))).over(_by()))
    # The pivot's row is there twice, once as the new element; a list is sorted once and meets nothing.
    rows = rows.withColumn("_new", F.explode(F.when(F.col("i") == F.col("_at"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    later = (F.col("i") > F.col("_at")) | ((F.col("i") == F.col("_at")) & (F.col("_new") == F.lit(after)))
    return rows.select("key", F.when(later, F.col("i") + 1).otherwise(F.col("i")).alias("i"), F.when(F.col("_new"), F.lit(value)).otherwise(F.col("value")).alias("value"))


def rpoplpush(table: DataFrame, source: str, target: str, from_left: bool = False, to_left: bool = True) -> DataFrame:
    """The table with one element moved between lists (RPOPLPUSH, LMOVE)."""
    own = table.where(F.col("key") == source)
    moved = own.orderBy("pos" if from_left else F.col("pos").desc()).limit(1).select(F.col("pos").alias("_from"), "value")
    ends = table.where(F.col("key") == target).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    pos = F.coalesce(F.col("_lo") - 1, F.lit(0)) if to_left else F.coalesce(F.col("_hi") + 1, F.lit(0))
    put = moved.join(F.broadcast(ends)).select(F.lit(target).alias("key"), pos.cast("long").alias("pos"), "value")
    rest = table.join(moved.select("_from"), (F.col("key") == source) & (F.col("pos") == F.col("_from")), "left_anti")
    return rest.unionByName(put)


def lmpop(table: DataFrame, keys: list[str], count: int = 1, right: bool = False) -> DataFrame:
    """The first elements of the first of these lists that has any."""
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    own = table.where(F.col("key").isin(keys)).withColumn("_r", rank)
    first = own.agg(F.min("_r").alias("_r"))
    top = own.join(F.broadcast(first), "_r").withColumn("rank", F.row_number().over(_tail() if right else _head()))
    return top.where(F.col("rank") <= count).select("key", "rank", "value")


def as_array(table: DataFrame) -> DataFrame:
    """``key`` and ``items``, an array in order."""
    return table.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("items"))
