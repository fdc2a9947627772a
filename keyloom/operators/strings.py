"""Operators on strings, counters and bit arrays, and on their log of writes.

Tables: ``kv_string (key, value)``; a log has ``key``, ``seq`` (the order of
writes), and what the operator names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..functions.text import strict_range


def last_write(log: DataFrame, *keys: str) -> DataFrame:
    """The row of the largest ``seq`` of each key (SET, MSET): last writer wins.

    An aggregate, so that writes are combined before the shuffle.
    """
    names = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*names), "seq").alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in names])


def first_write(log: DataFrame, *keys: str) -> DataFrame:
    """The row of the least ``seq`` of each key (SETNX)."""
    names = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*names), "seq").alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in names])


def set_ex(log: DataFrame) -> DataFrame:
    """``key``, ``value`` and ``expire_at`` after writes with deadlines (SET EX, PX, KEEPTTL, SETEX, PSETEX).

    The log has ``seq``, ``at`` (time of the write), ``ttl_ms`` (null: none,
    which drops an earlier deadline) and, where asked, ``keep`` (true: the
    earlier deadline stays). One aggregate: writes are combined before the
    shuffle.
    """
    keep = F.coalesce("keep", F.lit(False)) if "keep" in log.columns else F.lit(False)
    deadline = F.struct(F.timestamp_millis(F.unix_millis("at") + F.col("ttl_ms")).alias("t"))
    last = log.groupBy("key").agg(F.max_by(F.struct("value"), "seq").alias("_v"), F.max_by(deadline, F.when(~keep, F.col("seq"))).alias("_d"))
    return last.select("key", F.col("_v.value").alias("value"), F.col("_d.t").alias("expire_at"))


def set_xx(strings: DataFrame, writes: DataFrame) -> DataFrame:
    """The table (key, value) with the last write (key, value, seq) of each key that it has already (SET XX)."""
    last = last_write(writes, "key").select("key", F.struct("value").alias("_new"))
    return strings.join(last, "key", "left").withColumn("value", F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value"))).drop("_new")


def get(strings: DataFrame, key: str) -> DataFrame:
    return strings.where(F.col("key") == key).select("value")


def mget(strings: DataFrame, wanted: list[str]) -> DataFrame:
    """``pos``, ``key`` and ``value`` in the order asked; null where the key is absent."""
    asked = strings.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in wanted])).alias("pos", "key"))
    return F.broadcast(asked).join(strings.where(F.col("key").isin(wanted)).select("key", "value"), "key", "left").select("pos", "key", "value")


def getset(log: DataFrame) -> DataFrame:
    """Each write with the value before it, null for the first."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def getdel(strings: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The value of a key, and the table without it."""
    return get(strings, key), strings.where(F.col("key") != key)


def getex(strings: DataFrame, key: str, at) -> tuple[DataFrame, DataFrame]:
    """The value of a key, and the table with its deadline changed."""
    return get(strings, key), strings.withColumn("expire_at", F.when(F.col("key") == key, at).otherwise(F.col("expire_at")))


def msetnx(strings: DataFrame, pairs: DataFrame) -> DataFrame:
    """The table with all pairs, or as it was where one of their keys exists."""
    taken = pairs.join(strings, "key", "left_semi").limit(1).select(F.lit(1).alias("_taken"))
    return strings.unionByName(pairs.withColumn("_one", F.lit(1)).join(taken, F.col("_one") == F.col("_taken"), "left_anti").drop("_one"))


def counters(log: DataFrame, delta: str = "delta") -> DataFrame:
    """Sum of the changes of each key (INCR, INCRBY, DECR, DECRBY, INCRBYFLOAT); whole numbers beyond 64 bits are an error."""
    return log.groupBy("key").agg(F.sum(delta).alias("value"))


def append(log: DataFrame) -> DataFrame:
    """All values of each key joined in order, with the byte length."""
    joined = log.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "").alias("value"))
    return joined.withColumn("length", F.octet_length("value").cast("long"))


def strlen(strings: DataFrame) -> DataFrame:
    return strings.select("key", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("length"))


def getrange(strings: DataFrame, start: int, stop: int) -> DataFrame:
    """Inclusive byte slice; null where the range is out of the value."""
    first, size = strict_range(F.octet_length("value"), start, stop)
    return strings.select("key", F.substring(F.col("value").cast("binary"), (first + 1).cast("int"), size.cast("int")).cast("string").alias("part"))


def setrange(strings: DataFrame, offset: int, put: str) -> DataFrame:
    """Bytes from an offset overwritten, a gap filled with zero bytes."""
    if offset < 0:
        raise ValueError("offset is out of range")
    n = len(put.encode())
    value = F.col("value").cast("binary")
    head = F.substring(value, F.lit(1), F.lit(offset))
    gap = F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(offset) - F.octet_length(value), F.lit(0))))
    tail = F.substring(value, F.lit(offset + n + 1), F.greatest(F.octet_length(value) - (offset + n), F.lit(0)))
    return strings.withColumn("value", F.concat(head, gap, F.lit(put.encode()), tail))


def bitmap(offsets: DataFrame) -> DataFrame:
    """Bit arrays (``key``, ``bucket``, ``bits``) from set offsets (``key``, ``off``), in pieces of 32,768 bits."""
    return offsets.groupBy("key", F.expr("bitmap_bucket_number(off + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(off + 1))").alias("bits"))


def getbit(strings: DataFrame, offset: int) -> DataFrame:
    return strings.select("key", bits.get_bit(F.col("value").cast("binary"), offset).alias("bit"))


def setbit(strings: DataFrame, offset: int, bit: int) -> DataFrame:
    """The table with a bit put, and ``old``, the bit before."""
    value = F.col("value").cast("binary")
    place = offset // 8
    padded = F.concat(value, F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(place + 1) - F.octet_length(value), F.lit(0)))))
    byte = bits.byte_at(value, F.lit(place))
    new = byte.bitwiseOR(F.lit(1 << offset % 8)) if bit else byte.bitwiseAND(F.lit(255 & ~(1 << offset % 8)))
    whole = F.concat(F.substring(padded, F.lit(1), F.lit(place)), F.unhex(F.lpad(F.hex(new), 2, "0")), F.substring(padded, F.lit(place + 2), F.octet_length(padded)))
    return strings.withColumn("old", bits.get_bit(value, offset)).withColumn("value", whole)


def bitcount(strings: DataFrame, start: int | None = None, stop: int = -1, by_bit: bool = False) -> DataFrame:
    """Set bits of each value, of an inclusive range of bytes or bits; 0 where the range is out of the value."""
    value = F.col("value").cast("binary")
    if start is None:
        n = bits.bit_count(value)
    elif by_bit:
        first, size = strict_range(F.octet_length(value) * 8, start, stop)
        n = F.when(first.isNull(), 0).otherwise(F.aggregate(F.sequence(first, F.greatest(first + size - 1, first)), F.lit(0).cast("long"), lambda a, i: a + bits.get_bit(value, i)))
    else:
        first, size = strict_range(F.octet_length(value), start, stop)
        n = F.when(first.isNull(), 0).otherwise(bits.bit_count(value, first, size))
    return strings.select("key", n.cast("long").alias("n"))


def bitpos(strings: DataFrame, bit: int, start: int | None = None, stop: int = -1) -> DataFrame:
    """First offset of a bit in each value, or in an inclusive range of its bytes; -1 where there is none."""
    value = F.col("value").cast("binary")
    if start is None:
        return strings.select("key", bits.bit_position(value, bit).alias("pos"))
    first, size = strict_range(F.octet_length(value), start, stop)
    at = bits.bit_position(F.substring(value, (first + 1).cast("int"), size.cast("int")), bit)
    return strings.select("key", F.when(first.isNull() | (at < 0), -1).otherwise(at + first * 8).cast("long").alias("pos"))


def bitmap_pos(offsets: DataFrame, bit: int = 1) -> DataFrame:
    """First offset of a bit of each key, from its set offsets (``key``, ``off``)."""
    if bit:
        return offsets.groupBy("key").agg(F.min("off").alias("pos"))
    ranked = offsets.distinct().withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("off")) - 1)
    run = F.sum(F.when(F.col("off") == F.col("_n"), 1).otherwise(0))
    return ranked.groupBy("key").agg(run.cast("long").alias("pos"))


def bitop(offsets: DataFrame, op: str, sources: list[str]) -> DataFrame:
    """Offsets set in all (and), any (or) or an odd number (xor) of the sources."""
    hits = offsets.where(F.col("key").isin(sources)).distinct().groupBy("off").agg(F.count("*").alias("n"))
    keep = {"and": F.col("n") == len(set(sources)), "or": F.lit(True), "xor": F.col("n") % 2 == 1}[op.lower()]
    return hits.where(keep).select("off")


def lcs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs with ``lcs``, a longest common subsequence of their bytes, and ``length``.

    Where several are longest, walking back from the ends keeps the first
    value unless the table favours leaving it out. No built-in expresses the
    table, so rows pass through Python in Arrow batches, where the tables of
    pairs of like lengths are made together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            found = _subsequences([(x or "").encode() for x in p[a]], [(y or "").encode() for y in p[b]])
            yield p.assign(lcs=[f.decode(errors="replace") for f in found], length=[len(f) for f in found])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([*pairs.schema.fields]).add("lcs", StringType()).add("length", LongType())
    return pairs.mapInPandas(run, schema)


#: Entries of the tables that ``lcs`` makes together; one pair may have more.
TABLE = 1 << 22


def _subsequences(xs: list[bytes], ys: list[bytes]) -> list[bytes]:
    """A longest common subsequence of each pair."""
    out: list[bytes] = [b""] * len(xs)
    m, n = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    order = np.lexsort((n, m))
    start = 0
    while start < len(order):
        # As many pairs as fit; lengths of x rise, so the last has the longest.
        width = np.maximum.accumulate(n[order[start:]]) + 1
        size = max(1, int(np.searchsorted((m[order[start:]] + 1) * width * np.arange(1, len(width) + 1), TABLE, side="right")))
        some = order[start : start + size]
        for i, found in zip(some.tolist(), _together([xs[i] for i in some], [ys[i] for i in some]), strict=True):
            out[i] = found
        start += size
    return out


def _padded(values: list[bytes], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the values, one row for each place, and their lengths."""
    size = np.array([len(v) for v in values])
    out = np.full((len(values), max(size.max(), 1)), fill, np.int16)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer(b"".join(values), np.uint8)
    return np.ascontiguousarray(out.T), size


def _together(xs: list[bytes], ys: list[bytes]) -> list[bytes]:
    (x, i), (y, j) = _padded(xs, -1), _padded(ys, -2)
    table = np.zeros((len(x) + 1, len(y) + 1, len(xs)), np.int16 if min(len(x), len(y)) < 1 << 15 else np.int32)
    for at, c in enumerate(x):
        last, row = table[at], table[at + 1]
        # A match adds 1 to what ends before it; between matches the largest so far goes on.
        row[1:] = np.maximum(last[1:], np.where(y == c, last[:-1] + 1, 0))
        np.maximum.accumulate(row, axis=0, out=row)
    length = table[i, j, np.arange(len(xs))].astype(int)
    out, left = np.zeros((len(xs), max(length.max(), 1)), np.uint8), length.copy()
    while len(open_ := np.nonzero(left)[0]):
        p, q = i[open_], j[open_]
        same = x[p - 1, open_] == y[q - 1, open_]
        up = ~same & (table[p - 1, q, open_] > table[p, q - 1, open_])
        hit = open_[same]
        left[hit] -= 1
        out[hit, left[hit]] = x[p[same] - 1, hit]
        i[open_] -= same | up
        j[open_] -= ~up
    return [bytes(row[:k]) for row, k in zip(out, length.tolist(), strict=True)]


def lcs_matches(a: str, b: str, least: int, spark) -> DataFrame:
    """All common substrings of at least ``least`` characters at every pair of places (``start1``, ``start2``, ``size``)."""
    x = spark.range(len(a)).select(F.col("id").alias("i"), F.substring(F.lit(a), F.col("id").cast("int") + 1, F.lit(1)).alias("c"))
    y = spark.range(len(b)).select(F.col("id").alias("j"), F.substring(F.lit(b), F.col("id").cast("int") + 1, F.lit(1)).alias("c"))
    same = x.join(y, "c").withColumn("diagonal", F.col("j") - F.col("i"))
    run = same.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("diagonal").orderBy("i")))
    size = F.count("*").over(Window.partitionBy("diagonal", "island").orderBy("i").rowsBetween(0, Window.unboundedFollowing))
    return run.select(F.col("i").alias("start1"), F.col("j").alias("start2"), size.alias("size")).where(F.col("size") >= least)
