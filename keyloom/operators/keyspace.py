"""Operators on the key space: scans, deadlines, renames, sorting.

A key space is a table with columns ``key``, ``type`` and ``expire_at``
(timestamp, null without a deadline). ``now`` is a timestamp column, so that
results are the same in reruns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import matches

#: Names of encodings by type (fixed values).
ENCODINGS = {"string": "raw", "list": "quicklist", "hash": "hashtable", "set": "hashtable", "zset": "skiplist"}


def live(keys: DataFrame, now: Column) -> DataFrame:
    """Rows whose deadline has not passed."""
    return keys.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def key_space(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys of several tables (type name to table with ``key`` and, where it has deadlines, ``expire_at``)."""
    out = None
    for kind, t in tables.items():
        at = F.col("expire_at") if "expire_at" in t.columns else F.lit(None).cast("timestamp")
        part = t.select(F.col("key").cast("string").alias("key"), F.lit(kind).alias("type"), at.alias("expire_at")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def keys(space: DataFrame, pattern: str, now: Column) -> DataFrame:
    """Live keys whose name matches a glob."""
    return live(space, now).where(matches(F.col("key"), pattern)).select("key")


def scan(space: DataFrame, after: str | None = None, pattern: str = "*", count: int = 10, kind: str | None = None) -> DataFrame:
    """The next ``count`` keys by name after a cursor, which is the last key of the page before."""
    page = space.where(matches(F.col("key"), pattern))
    if kind:
        page = page.where(F.col("type") == kind)
    if after is not None:
        page = page.where(F.col("key") > after)
    return page.select("key", "type").orderBy("key", "type").limit(count)


def random_key(space: DataFrame, seed: int = 0) -> DataFrame:
    """One key, chosen by a seeded hash."""
    return space.select("key").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1)


def exists(space: DataFrame, names: DataFrame) -> DataFrame:
    """``n``: how many of the names exist, repeated names counted as often as they are asked."""
    return names.select("key").join(space.select("key").distinct(), "key", "left_semi").agg(F.count("*").alias("n"))


touch = exists


def exist_in(space: DataFrame, names: DataFrame) -> DataFrame:
    """Those of the names that exist."""
    return names.select("key").join(space.select("key"), "key", "left_semi").distinct()


def type_of(space: DataFrame, names: DataFrame) -> DataFrame:
    """Type of each name, ``none`` where it doesn't exist."""
    return names.select("key").join(space.select("key", "type"), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def encoding_of(space: DataFrame) -> DataFrame:
    """Encoding, reference count, idle time and frequency of each key."""
    names = F.create_map(*[F.lit(x) for kv in ENCODINGS.items() for x in kv])
    return space.select("key", F.coalesce(names[F.col("type")], F.lit("unknown")).alias("encoding"), F.lit(1).alias("refcount"), F.lit(0).alias("idletime"), F.lit(0).alias("freq"))


def delete(table: DataFrame, names: DataFrame) -> DataFrame:
    """The table without the rows of these keys."""
    return table.join(names.select("key").distinct(), "key", "left_anti")


unlink = delete


def rename(table: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of ``old`` under the name ``new``, whose own rows go; the table itself where ``old`` is absent."""
    there = table.where(F.col("key") == old).select(F.lit(new).alias("_new")).limit(1)
    kept = table.join(there, (F.col("key") == F.col("_new")) & (F.lit(old) != new), "left_anti")
    return kept.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def rename_nx(table: DataFrame, old: str, new: str) -> DataFrame:
    """As ``rename`` only where ``new`` is absent."""
    taken = table.where(F.col("key") == new).select(F.lit(old).alias("_old")).limit(1)
    marked = table.join(F.broadcast(taken), F.col("key") == F.col("_old"), "left")
    return marked.withColumn("key", F.when((F.col("key") == old) & F.col("_old").isNull(), new).otherwise(F.col("key"))).drop("_old")


def expire_at(table: DataFrame, names: DataFrame, at: Column) -> DataFrame:
    """The table with a deadline put on these keys; a null deadline drops it."""
    hit = names.select("key").distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, "key", "left").withColumn("expire_at", F.when(F.col("_hit"), at).otherwise(F.col("expire_at"))).drop("_hit")


def expire(table: DataFrame, names: DataFrame, now: Column, millis: int) -> DataFrame:
    """A deadline so many milliseconds after ``now``."""
    return expire_at(table, names, F.timestamp_millis(F.unix_millis(now) + millis))


def persist(table: DataFrame, names: DataFrame) -> DataFrame:
    """The table without deadlines on these keys."""
    return expire_at(table, names, F.lit(None).cast("timestamp"))


def deadlines(space: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """``ttl``, ``pttl``, ``expiretime`` and ``pexpiretime`` of each name: -2 without the key, -1 without a deadline.

    ``ttl`` is rounded half away from zero, ``expiretime`` cut to whole seconds.
    """
    j = names.select("key").join(space.select("key", "expire_at", F.lit(True).alias("_there")), "key", "left")

    def of(value: Column) -> Column:
        return F.when(F.col("_there").isNull(), -2).when(F.col("expire_at").isNull(), -1).otherwise(value).cast("long")

    left = F.unix_micros("expire_at") - F.unix_micros(now)
    return j.select("key", of(F.round(left / 1e6)).alias("ttl"), of(F.unix_millis("expire_at") - F.unix_millis(now)).alias("pttl"), of(F.unix_seconds("expire_at")).alias("expiretime"), of(F.unix_millis("expire_at")).alias("pexpiretime"))


def dump(strings: DataFrame, now: Column) -> DataFrame:
    """``key`` and ``blob``: a type byte, four bytes of milliseconds left (0 without a deadline), the value."""
    left = F.greatest(F.coalesce(F.unix_millis("expire_at") - F.unix_millis(now), F.lit(0)), F.lit(0))
    return strings.select("key", F.concat(F.unhex(F.lit("00")), F.unhex(F.lpad(F.hex(left), 8, "0")), F.col("value").cast("binary")).alias("blob"))


def restore(blobs: DataFrame, now: Column | None = None, table: DataFrame | None = None, replace: bool = False) -> DataFrame:
    """``key``, ``value`` and ``expire_at`` of what ``dump`` gave; the deadline begins anew at ``now``.

    With a ``table`` (key, value, expire_at) the result is that table with the
    restored keys. A key that is there already stays as it is, or is replaced
    with ``replace``.
    """
    left = F.conv(F.hex(F.expr("substring(blob, 2, 4)")), 16, 10).cast("long")
    at = F.when(left > 0, F.timestamp_millis(F.unix_millis(now) + left)) if now is not None else F.lit(None)
    new = blobs.select("key", F.expr("substring(blob, 6)").alias("value"), at.cast("timestamp").alias("expire_at"))
    if table is None:
        return new
    old = table.select("key", F.col("value").cast("binary").alias("value"), "expire_at")
    if replace:
        return old.join(new.select("key"), "key", "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select("key").distinct(), "key", "left_anti"))


def sort(elements: DataFrame, by: DataFrame | None = None, get: DataFrame | None = None, alpha: bool = False, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Elements (``value``) in order, with a looked-up weight and result.

    ``by`` and ``get`` have columns ``value`` and ``weight`` or ``result``;
    without ``by`` the element itself is the weight, a number unless
    ``alpha``. Ties go by the element. A limit is one top-k, not a full sort;
    the results are looked up for what it leaves, and put in order again.
    """
    rows = elements.select("value")
    rows = rows.join(by.select("value", "weight"), "value", "left") if by is not None else rows.withColumn("weight", F.col("value"))
    weight = F.col("weight").cast("string") if alpha else F.col("weight").cast("double")
    order = (weight.desc_nulls_last() if descending else weight.asc_nulls_first(), F.col("value").desc() if descending else F.col("value"))
    if limit is not None:
        rows = rows.orderBy(*order).offset(offset).limit(limit)
    if get is None:
        return rows if limit is not None else rows.orderBy(*order)
    found = get.select("value", "result")
    if limit is None:
        return rows.join(found, "value", "left").orderBy(*order)
    # A second sort by the same columns may be dropped as redundant by adaptive execution, though the join undoes the first: places are numbered.
    placed = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return placed.join(found, "value", "left").orderBy("_n").drop("_n")


def versions(log: DataFrame) -> DataFrame:
    """Number of writes of each key."""
    return log.groupBy("key").agg(F.count("*").alias("version"))


def copy(table: DataFrame, old: str, new: str, replace: bool = False) -> DataFrame:
    """The table with the rows of ``old`` also under ``new``; those of ``new`` go, or stay alone without ``replace``."""
    copied = table.where(F.col("key") == old).withColumn("key", F.lit(new))
    if replace:
        return table.where(F.col("key") != new).unionByName(copied)
    return table.unionByName(copied.join(table.where(F.col("key") == new).select("key").distinct(), "key", "left_anti"))


def move(table: DataFrame, key: str, db: int, to: int) -> DataFrame:
    """A table with a ``db`` column, with a key moved to another database where it is not there yet."""
    taken = table.where((F.col("db") == to) & (F.col("key") == key)).select("key").distinct().withColumn("_taken", F.lit(True))
    moved = F.when((F.col("db") == db) & (F.col("key") == key) & F.col("_taken").isNull(), to).otherwise(F.col("db"))
    return table.join(taken, "key", "left").withColumn("db", moved.cast("int")).drop("_taken")


def swap(table: DataFrame, a: int, b: int) -> DataFrame:
    """The table with two databases exchanged."""
    return table.withColumn("db", F.when(F.col("db") == a, b).when(F.col("db") == b, a).otherwise(F.col("db")))


def size(space: DataFrame) -> DataFrame:
    """Number of different keys."""
    return space.agg(F.count_distinct("key").alias("n"))


def flush(table: DataFrame) -> DataFrame:
    """An empty table of the same columns."""
    return table.limit(0)


def slot(key: Column, slots: int = 1024) -> Column:
    """Partition of a key: crc32 of its ``{tag}``, or of all of it."""
    tag = F.regexp_extract(key, r"\{([^}]+)\}", 1)
    return (F.crc32(F.when(tag != "", tag).otherwise(key).cast("binary")) % slots).cast("int")
