"""Operators on streams: ``kv_stream (key, ms, seq, fields)``, entries in order of (ms, seq).

Consumer groups: ``kv_group (key, grp, last_ms, last_seq)`` and ``kv_pending
(key, grp, ms, seq, consumer, delivered_at, deliveries)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _by() -> WindowSpec:
    return Window.partitionBy("key")


ID = ["ms", "seq"]


def xadd(rows: DataFrame) -> DataFrame:
    """Numbers entries (key, ms, and ``n`` for their order) within their millisecond: ``seq`` from 0."""
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("key", "ms").orderBy("n")) - 1).cast("long"))


def accepted(rows: DataFrame) -> DataFrame:
    """Entries of a log (key, ms, seq, n) whose id is above all ids before; others are refused."""
    before = _by().orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*ID)
    return rows.withColumn("_top", F.max(at).over(before)).where(F.col("_top").isNull() | (at > F.col("_top"))).drop("_top")


def xadd_to(table: DataFrame, rows: DataFrame, maxlen: int | None = None, minid: str | None = None, only_existing: bool = False) -> DataFrame:
    """The streams with more entries, then trimmed to a length or a least id; ``only_existing`` makes no new stream (NOMKSTREAM)."""
    new = rows.join(table.select("key").distinct(), "key", "left_semi") if only_existing else rows
    out = table.unionByName(new.select(*table.columns))
    out = out if minid is None else xtrim_minid(out, minid)
    return out if maxlen is None else xtrim_maxlen(out, maxlen)


def xlen(table: DataFrame) -> DataFrame:
    return table.groupBy("key").agg(F.count("*").alias("n"))


def _id(text: str, low: bool) -> tuple[int, int]:
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else 0 if low else (1 << 63) - 1


def id_between(start: str, stop: str) -> Column:
    """Condition of ids start..stop (inclusive): ``ms``, ``ms-seq``, ``-`` or ``+``."""
    out: Column = F.lit(True)
    if start != "-":
        ms, seq = _id(start, True)
        out = out & (F.col("ms") >= ms) & ((F.col("ms") > ms) | (F.col("seq") >= seq))
    if stop != "+":
        ms, seq = _id(stop, False)
        out = out & (F.col("ms") <= ms) & ((F.col("ms") < ms) | (F.col("seq") <= seq))
    return out


def xrange(table: DataFrame, start: str = "-", stop: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """Entries of an id range of each stream with their ``rank``, the first or last ``count`` of them."""
    order = _by().orderBy(*[F.col(c).desc() if reverse else F.col(c) for c in ID])
    rows = table.where(id_between(start, stop))
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows if count is None else rows.where(F.col("rank") <= count)


def xread(table: DataFrame, after: DataFrame, count: int | None = None) -> DataFrame:
    """Entries after the given id of each stream (``after``: key, last_ms, last_seq)."""
    later = (F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))
    rows = table.join(after.select("key", "last_ms", "last_seq"), "key").where(later).drop("last_ms", "last_seq")
    rows = rows.withColumn("rank", F.row_number().over(_by().orderBy(*ID)))
    return rows if count is None else rows.where(F.col("rank") <= count)


def xdel(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("key", *ID).distinct(), ["key", *ID], "left_anti")


def xtrim_maxlen(table: DataFrame, n: int) -> DataFrame:
    """The newest n entries of each stream."""
    rank = F.row_number().over(_by().orderBy(*[F.col(c).desc() for c in ID]))
    return table.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def xtrim_minid(table: DataFrame, least: str) -> DataFrame:
    return table.where(id_between(least, "+"))


def xreadgroup(table: DataFrame, groups: DataFrame, consumer: str, now: Column, count: int | None = None, noack: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entries for a consumer of each group, the pending rows they make, and the groups with their cursor at the last entry given.

    With ``noack`` the entries count as acknowledged and make no pending rows.
    """
    g = groups.select("key", "grp", "last_ms", "last_seq")
    later = (F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))
    rows = table.join(g, "key").where(later).withColumn("rank", F.row_number().over(Window.partitionBy("key", "grp").orderBy(*ID)))
    rows = rows if count is None else rows.where(F.col("rank") <= count)
    given = rows.drop("last_ms", "last_seq")
    pending = given.select("key", "grp", *ID, F.lit(consumer).alias("consumer"), now.alias("delivered_at"), F.lit(1).alias("deliveries")).where(F.lit(not noack))
    top = given.groupBy("key", "grp").agg(F.max(F.struct(*ID)).alias("_x"))
    moved = g.join(top, ["key", "grp"], "left").select("key", "grp", F.coalesce("_x.ms", "last_ms").alias("last_ms"), F.coalesce("_x.seq", "last_seq").alias("last_seq"))
    return given, pending, moved


def xread_pending(table: DataFrame, pending: DataFrame, consumer: str, after: str = "0", count: int | None = None) -> DataFrame:
    """Entries that are pending for a consumer in each group, above an id: those read but not acknowledged, once more."""
    ms, seq = _id(after, True)
    own = pending.where((F.col("consumer") == consumer) & ((F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))))
    rows = table.join(own.select("key", "grp", *ID, "deliveries"), ["key", *ID])
    rank = F.row_number().over(Window.partitionBy("key", "grp").orderBy(*ID))
    rows = rows.withColumn("rank", rank)
    return rows if count is None else rows.where(F.col("rank") <= count)


def consumer_create(consumers: DataFrame, key: str, grp: str, consumer: str) -> DataFrame:
    """The consumers (key, grp, consumer) with one more; one that is there stays alone."""
    row = consumers.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(grp).alias("grp"), F.lit(consumer).alias("consumer"))
    return consumers.select("key", "grp", "consumer").union(row).distinct()


def xack(pending: DataFrame, ids: DataFrame) -> DataFrame:
    return pending.join(ids.select("key", "grp", *ID).distinct(), ["key", "grp", *ID], "left_anti")


def xpending(pending: DataFrame) -> DataFrame:
    """For each group and consumer the number of pending entries, with the least and largest id."""
    return pending.groupBy("key", "grp", "consumer").agg(F.count("*").alias("n"), F.min(F.struct(*ID)).alias("_a"), F.max(F.struct(*ID)).alias("_b")).select("key", "grp", "consumer", "n", F.col("_a.ms").alias("min_ms"), F.col("_a.seq").alias("min_seq"), F.col("_b.ms").alias("max_ms"), F.col("_b.seq").alias("max_seq"))


def xpending_range(pending: DataFrame, start: str, stop: str, count: int, now: Column, consumer: str | None = None) -> DataFrame:
    """The first pending entries of each group in an id range, with the milliseconds since their delivery."""
    rows = pending.where(id_between(start, stop))
    if consumer is not None:
        rows = rows.where(F.col("consumer") == consumer)
    rank = F.row_number().over(Window.partitionBy("key", "grp").orderBy(*ID))
    idle = F.unix_millis(now) - F.unix_millis("delivered_at")
    return rows.withColumn("rank", rank).where(F.col("rank") <= count).withColumn("idle_ms", idle)


def xclaim(pending: DataFrame, consumer: str, min_idle_ms: int, now: Column) -> DataFrame:
    """The pending table with entries idle for so long given to a consumer."""
    hit = (F.unix_millis(now) - F.unix_millis("delivered_at")) >= min_idle_ms
    return pending.withColumns({"consumer": F.when(hit, consumer).otherwise(F.col("consumer")), "deliveries": F.when(hit, F.col("deliveries") + 1).otherwise(F.col("deliveries")), "delivered_at": F.when(hit, now).otherwise(F.col("delivered_at"))})


def group_create(groups: DataFrame, key: str, grp: str, last_ms: int = 0, last_seq: int = 0) -> DataFrame:
    """The groups with one more, or with its cursor moved (CREATE, SETID)."""
    row = groups.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(grp).alias("grp"), F.lit(last_ms).cast("long").alias("last_ms"), F.lit(last_seq).cast("long").alias("last_seq"))
    return group_destroy(groups, key, grp).unionByName(row)


def group_destroy(groups: DataFrame, key: str, grp: str) -> DataFrame:
    return groups.where(~((F.col("key") == key) & (F.col("grp") == grp)))


def consumer_delete(pending: DataFrame, key: str, grp: str, consumer: str) -> DataFrame:
    """The pending table with a consumer's entries left to the group (null consumer)."""
    own = (F.col("key") == key) & (F.col("grp") == grp) & (F.col("consumer") == consumer)
    return pending.withColumn("consumer", F.when(own, F.lit(None).cast("string")).otherwise(F.col("consumer")))


def info_groups(groups: DataFrame, pending: DataFrame) -> DataFrame:
    """Each group with its cursor, consumers and pending entries."""
    n = pending.groupBy("key", "grp").agg(F.count_distinct("consumer").alias("consumers"), F.count("*").alias("pending"))
    return groups.join(n, ["key", "grp"], "left").fillna(0, ["consumers", "pending"])
