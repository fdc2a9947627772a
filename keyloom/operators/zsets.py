"""Operators on scored sets: table ``kv_zset (key, member, score)``, ordered by (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import clamp_range, matches
from .strings import last_write


def _by() -> WindowSpec:
    return Window.partitionBy("key")


def _up() -> WindowSpec:
    return _by().orderBy("score", "member")


def _down() -> WindowSpec:
    return _by().orderBy(F.col("score").desc(), F.col("member").desc())


def zadd(log: DataFrame) -> DataFrame:
    """Last score of each (key, member) of a log with ``seq``."""
    return last_write(log, "key", "member").select("key", "member", "score")


def zincrby(log: DataFrame) -> DataFrame:
    return log.groupBy("key", "member").agg(F.sum("delta").alias("score"))


def zmscore(table: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Score of each member asked, null where absent (ZSCORE, ZMSCORE)."""
    return members.select("member").join(table.where(F.col("key") == key).select("member", "score"), "member", "left")


def zcard(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def score_between(low: str, high: str, score: Column | None = None) -> Column:
    """Condition of a score range: numbers, ``(x`` without its end, ``-inf``, ``+inf``."""
    score = F.col("score") if score is None else score
    out: Column = F.lit(True)
    for text, up in ((low, True), (high, False)):
        if text.lower() in ("inf", "+inf"):
            out = out & (F.lit(False) if up else F.lit(True))
        elif text.lower() == "-inf":
            out = out & (F.lit(True) if up else F.lit(False))
        elif text.startswith("("):
            x = float(text[1:])
            out = out & (score > x if up else score < x)
        else:
            out = out & (score >= float(text) if up else score <= float(text))
    return out


def lex_between(low: str, high: str) -> Column:
    """Condition of a range of names: ``[x``, ``(x`` without its end, ``-``, ``+``."""
    member, out = F.col("member"), F.lit(True)
    for text, up in ((low, True), (high, False)):
        if text in ("-", "+"):
            out = out & F.lit((text == "-") == up)
        elif text.startswith("("):
            out = out & (member > text[1:] if up else member < text[1:])
        elif text.startswith("["):
            out = out & (member >= text[1:] if up else member <= text[1:])
        else:
            raise ValueError("a border begins with [ or (, or is - or +")
    return out


def zcount(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.groupBy("key").agg(F.count(F.when(score_between(low, high), 1)).alias("n"))


def zlexcount(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.groupBy("key").agg(F.count(F.when(lex_between(low, high), 1)).alias("n"))


def ranked(table: DataFrame, reverse: bool = False) -> DataFrame:
    """The table with ``rank`` from 0, ascending or descending (ZRANK, ZREVRANK)."""
    return table.withColumn("rank", (F.row_number().over(_down() if reverse else _up()) - 1).cast("long"))


def _first(table: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    """The first n members of each key with ``rank``; tasks keep n rows of a key before the shuffle."""
    rows = table.withColumn("_at", F.row_number().over(_down() if reverse else _up())).where(F.col("_at") <= n)
    return rows.withColumn("rank", (F.col("_at") - 1).cast("long")).drop("_at")


def zrange(table: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members of ranks start..stop of each key (inclusive, negative from the end).

    Ranges that start at the head and end by a positive rank read only that
    many rows of each key (a group limit under the window).
    """
    if start >= 0 and stop >= 0:
        return _first(table, stop + 1, reverse).where(F.col("rank") >= start)
    rows = ranked(table, reverse)
    first, size = clamp_range(F.col("_n"), start, stop)
    return rows.withColumn("_n", F.count("*").over(_by())).where((F.col("rank") >= first) & (F.col("rank") < first + size)).drop("_n")


def _limited(rows: DataFrame, reverse: bool, offset: int, limit: int) -> DataFrame:
    if offset < 0:
        return ranked(rows, reverse).limit(0)
    rows = ranked(rows, reverse) if limit < 0 else _first(rows, offset + limit, reverse)
    return rows.where(F.col("rank") >= offset)


def zrangebyscore(table: DataFrame, low: str, high: str, reverse: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """Members of a score range of each key with their rank in it, of which a part by offset and limit (below 0: all)."""
    return _limited(table.where(score_between(low, high)), reverse, offset, limit)


def zrangebylex(table: DataFrame, low: str, high: str, reverse: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    return _limited(table.where(lex_between(low, high)), reverse, offset, limit)


def zpop(table: DataFrame, count: int = 1, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is popped from each key, and what is left (ZPOPMIN, ZPOPMAX)."""
    return _first(table, count, largest), ranked(table, largest).where(F.col("rank") >= count).drop("rank")


def zmpop(table: DataFrame, keys: list[str], count: int = 1, largest: bool = False) -> DataFrame:
    """The first members of the first of these keys that has any."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    own = table.where(F.col("key").isin(keys)).withColumn("_r", place)
    return zpop(own.join(F.broadcast(own.agg(F.min("_r").alias("_r"))), "_r").drop("_r"), count, largest)[0]


def zrem(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.join(rows.select("key", "member").distinct(), ["key", "member"], "left_anti")


def zremrangebyscore(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.where(~score_between(low, high))


def zremrangebylex(table: DataFrame, low: str, high: str) -> DataFrame:
    return table.where(~lex_between(low, high))


def zremrangebyrank(table: DataFrame, start: int, stop: int) -> DataFrame:
    first, size = clamp_range(F.col("_n"), start, stop)
    rows = ranked(table).withColumn("_n", F.count("*").over(_by()))
    return rows.where(~((F.col("rank") >= first) & (F.col("rank") < first + size))).drop("rank", "_n")


def zscan(table: DataFrame, pattern: str) -> DataFrame:
    """Members that match a glob, scores as text with ten decimals."""
    return table.where(matches(F.col("member"), pattern)).select("key", "member", F.format_string("%.10f", F.col("score").cast("double")).alias("score"))


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _weighed(table: DataFrame, keys: list[str], weights: list[float] | None) -> DataFrame:
    by = dict(zip(keys, weights or [1.0] * len(keys), strict=True))
    weight = F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[F.col("key")]
    return table.where(F.col("key").isin(keys)).select("key", "member", (F.col("score") * weight).alias("score"))


def zunion(table: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """Members of any key; weighed scores put together by sum, min or max."""
    return _weighed(table, keys, weights).groupBy("member").agg(_AGG[aggregate.lower()]("score").alias("score"))


def zinter(table: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """Members of all keys; one aggregate instead of a join for each key."""
    both = _weighed(table, keys, weights).groupBy("member").agg(_AGG[aggregate.lower()]("score").alias("score"), F.count_distinct("key").alias("_n"))
    return both.where(F.col("_n") == len(set(keys))).drop("_n")


def zdiff(table: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first key that no other has, with their score."""
    rest = table.where(F.col("key").isin(keys[1:])).select("member")
    return table.where(F.col("key") == keys[0]).select("member", "score").join(rest, "member", "left_anti")


def stored(table: DataFrame, target: str, members: DataFrame) -> DataFrame:
    """The table with a scored set in place of ``target`` (ZUNIONSTORE, ZINTERSTORE, ZDIFFSTORE)."""
    return table.where(F.col("key") != target).select("key", "member", "score").union(members.select(F.lit(target), "member", "score"))
