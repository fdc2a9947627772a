"""Sketches: approximate counts, membership, heavy hitters and quantiles.

Sketches with a built-in aggregate use it; Bloom filter, cuckoo filter and
count-min sketch are tables of positions or counts, so that they are built,
merged and probed by aggregates and joins. A t-digest is a table of centroids,
of which each task makes its own and which are merged by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import byte_values

#: Registers of a distinct-count sketch, as a power of two.
REGISTERS = 14


def pfadd(rows: DataFrame, item: str = "item") -> DataFrame:
    """A distinct-count sketch for each key."""
    return rows.groupBy("key").agg(F.hll_sketch_agg(F.col(item), F.lit(REGISTERS)).alias("sketch"))


def pfmerge(sketches: DataFrame, keys: list[str], target: str) -> DataFrame:
    return sketches.where(F.col("key").isin(keys)).agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit(target).alias("key"), "sketch")


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("n"))


def bloom_size(error: float, capacity: int) -> tuple[int, int]:
    """Bits (64 at least) and hashes of a Bloom filter."""
    bits = max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2))
    return bits, max(1, math.ceil(bits / capacity * math.log(2)))


def _positions(item: Column, bits: int, hashes: int) -> Column:
    a, b = F.pmod(F.xxhash64(item.cast("string")), F.lit(bits)), F.pmod(F.xxhash64(item.cast("string"), F.lit(1)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(a + i.cast("long") * b, F.lit(bits)))


def bf_add(rows: DataFrame, bits: int, hashes: int, item: str = "item") -> DataFrame:
    """Bloom filters (``key``, ``bit``): the set positions."""
    return rows.select("key", F.explode(_positions(F.col(item), bits, hashes)).alias("bit")).distinct()


def bf_exists(bloom: DataFrame, asked: DataFrame, bits: int, hashes: int, item: str = "item") -> DataFrame:
    """The rows asked (key, item) with ``maybe`` (0 or 1): never 0 for an item that was added."""
    probe = asked.select("key", item).distinct().withColumn("bit", F.explode(F.array_distinct(_positions(F.col(item), bits, hashes))))
    hit = probe.join(bloom.withColumn("_set", F.lit(1)), ["key", "bit"], "left")
    return hit.groupBy("key", item).agg(F.min(F.coalesce("_set", F.lit(0))).alias("maybe"))


def bf_merge(*blooms: DataFrame) -> DataFrame:
    out = blooms[0]
    for b in blooms[1:]:
        out = out.unionByName(b)
    return out.distinct()


def bf_info(bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Size, hashes, set bits, load, estimated items and error of each filter."""
    n = bloom.groupBy("key").agg(F.count("*").alias("bit_count"))
    load = F.col("bit_count") / bits
    return n.select("key", F.lit(bits).alias("size"), F.lit(hashes).alias("hashes"), "bit_count", load.alias("load"), (-F.log(1 - F.least(load, F.lit(1 - 1e-12))) * (bits / hashes)).alias("items"), F.pow(load, hashes).alias("error"))


def multiset(log: DataFrame, item: str = "item") -> DataFrame:
    """Exact counts of items of a log with ``delta`` 1 or -1 (add and delete), without those that are gone."""
    return log.groupBy("key", item).agg(F.sum("delta").alias("n")).where(F.col("n") > 0)


def cf_exists(counts: DataFrame, asked: DataFrame, item: str = "item") -> DataFrame:
    """The rows asked (key, item) with ``n``, 0 where absent."""
    return asked.select("key", item).join(counts, ["key", item], "left").select("key", item, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bf_dump(bloom: DataFrame) -> DataFrame:
    """Filters as chunks (``key``, ``chunk``, ``bits``) of 32,768 bits (SCANDUMP)."""
    return bloom.groupBy("key", F.expr("bitmap_bucket_number(bit + 1)").alias("chunk")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))


def bf_load(chunks: DataFrame) -> DataFrame:
    """Filters from their chunks (LOADCHUNK); chunks loaded twice do no harm."""
    byte = F.posexplode(F.filter(F.transform(byte_values(F.col("bits")), lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: x["b"] != 0)).alias("_n", "_x")
    rows = chunks.select("key", "chunk", byte).select("key", ((F.col("chunk") - 1) * 32_768 + F.col("_x.i") * 8).alias("_at"), F.col("_x.b").alias("_b"))
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(F.col("_b"), k) == 1)
    return rows.select("key", F.explode(F.transform(places, lambda k: F.col("_at") + k)).alias("bit")).distinct()


def cf_size(capacity: int) -> int:
    """Buckets of a cuckoo filter: a power of two with room for four fingerprints each."""
    return 1 << max(0, math.ceil(math.log2(max(1, capacity) / 4)))


def _fingerprint(item: Column, buckets: int) -> list[Column]:
    h = F.xxhash64(item.cast("string"), F.lit("cuckoo"))
    return [F.pmod(h, F.lit(buckets)).alias("bucket"), (F.shiftrightunsigned(h, 32) % 65_535 + 1).alias("mark")]


def cf_add(log: DataFrame, buckets: int, item: str = "item") -> DataFrame:
    """Cuckoo filters (``key``, ``bucket``, ``mark``, ``n``) from a log with ``delta``: 1 adds an item, -1 deletes one.

    A bucket is no cell of fixed room but rows of a table, so that no mark is
    ever moved and none is refused. Marks have 16 bits: two items in a bucket
    are taken for each other once in 65,535 times.
    """
    return log.select("key", *_fingerprint(F.col(item), buckets), "delta").groupBy("key", "bucket", "mark").agg(F.sum("delta").alias("n")).where(F.col("n") > 0)


def cf_addnx(table: DataFrame, rows: DataFrame, buckets: int, item: str = "item") -> DataFrame:
    """The filters with items that they do not seem to hold yet, each once."""
    new = rows.select("key", *_fingerprint(F.col(item), buckets)).distinct().join(table, ["key", "bucket", "mark"], "left_anti")
    return table.unionByName(new.withColumn("n", F.lit(1).cast("long")))


def cf_count(table: DataFrame, asked: DataFrame, buckets: int, item: str = "item") -> DataFrame:
    """The rows asked (key, item) with ``n``, how often the filter seems to hold the item: never less than it does."""
    probe = asked.select("key", item, *_fingerprint(F.col(item), buckets))
    return probe.join(table, ["key", "bucket", "mark"], "left").select("key", item, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cf_dump(table: DataFrame, buckets_each: int = 4096) -> DataFrame:
    """Filters as chunks (``key``, ``chunk``, ``data``) of so many buckets (SCANDUMP)."""
    return table.groupBy("key", F.floor(F.col("bucket") / buckets_each).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("bucket", "mark", "n"))).alias("data"))


def cf_load(chunks: DataFrame) -> DataFrame:
    """Filters from their chunks (LOADCHUNK)."""
    return chunks.dropDuplicates(["key", "chunk"]).select("key", F.inline("data"))


def cms_size(error: float, confidence: float) -> tuple[int, int]:
    """Width and depth of a count-min sketch."""
    return math.ceil(math.e / error), math.ceil(math.log(1 / (1 - confidence)))


def _buckets(item: Column, width: int, depth: int) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: F.struct(r.alias("row"), F.pmod(F.xxhash64(item.cast("string"), r), F.lit(width)).alias("bucket"))))


def cms_add(rows: DataFrame, width: int, depth: int, item: str = "item", count: Column | None = None) -> DataFrame:
    """Count-min sketches (``key``, ``row``, ``bucket``, ``n``); repeated items are added up before they are dealt out."""
    per = rows.groupBy("key", item).agg(F.sum(F.lit(1) if count is None else count).alias("_n"))
    return per.select("key", "_n", _buckets(F.col(item), width, depth).alias("_b")).groupBy("key", "_b.row", "_b.bucket").agg(F.sum("_n").alias("n"))


def cms_merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("key", "row", "bucket").agg(F.sum("n").alias("n"))


def cms_query(sketch: DataFrame, asked: DataFrame, width: int, depth: int, item: str = "item") -> DataFrame:
    """Estimate of each item asked: its true count at least."""
    probe = asked.select("key", item).distinct().select("key", item, _buckets(F.col(item), width, depth).alias("_b")).select("key", item, "_b.row", "_b.bucket")
    return probe.join(sketch, ["key", "row", "bucket"], "left").groupBy("key", item).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def topk(rows: DataFrame, k: int, item: str = "item") -> DataFrame:
    """The k most frequent items of each key with exact counts, by count and item."""
    from pyspark.sql import Window

    n = rows.groupBy("key", item).agg(F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy(F.col("n").desc(), item)
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk_approx(rows: DataFrame, k: int, item: str = "item") -> DataFrame:
    """As ``topk`` from a bounded sketch of each key."""
    return rows.groupBy("key").agg(F.expr(f"approx_top_k({item}, {k})").alias("_top")).select("key", F.posexplode("_top").alias("_p", "_x")).select("key", (F.col("_p") + 1).alias("rank"), F.col("_x.item").alias(item), F.col("_x.count").alias("n"))


def topk_query(top: DataFrame, asked: DataFrame, item: str = "item") -> DataFrame:
    """1 for items that are in the top list, else 0."""
    return asked.select("key", item).join(top.select("key", item, F.lit(1).alias("_in")), ["key", item], "left").select("key", item, F.coalesce("_in", F.lit(0)).alias("found"))


def quantiles(rows: DataFrame, qs: list[float], value: str = "value", exact: bool = False) -> DataFrame:
    """Quantiles of each key from a sketch, or exact by interpolation."""
    cols = [(F.expr(f"percentile_cont({q}) within group (order by {value})") if exact else F.percentile_approx(value, F.lit(q), F.lit(10_000))).alias(f"q{i}") for i, q in enumerate(qs)]
    return rows.groupBy("key").agg(*cols)


def digest(rows: DataFrame, value: str = "value", compression: int = 100) -> DataFrame:
    """t-digests (``key``, ``mean``, ``weight``, ``min``, ``max``): centroids of the values of each key.

    Each task keeps one digest for each key it meets, of at most twice
    ``compression`` centroids and a buffer; only centroids are shuffled.
    Null and NaN values are left out.
    """
    schema = rows.select("key").schema.add("mean", "double").add("weight", "double").add("min", "double").add("max", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, tuple[np.ndarray, np.ndarray, float, float]] = {}
        for p in batches:
            p = p.dropna(subset=["value"])
            for key, part in p.groupby("key", dropna=False)["value"]:
                x = part.to_numpy(float)
                mean, weight, low, high = held.get(key, (np.empty(0), np.empty(0), np.inf, -np.inf))
                mean, weight = squeeze(np.concatenate([mean, x]), np.concatenate([weight, np.ones(len(x))]), compression)
                held[key] = (mean, weight, min(low, x.min()), max(high, x.max()))
        for key, (mean, weight, low, high) in held.items():
            yield pd.DataFrame({"key": [key] * len(mean), "mean": mean, "weight": weight, "min": low, "max": high})

    return digest_merge(rows.select("key", F.col(value).cast("double").alias("value")).mapInPandas(run, schema), compression)


def squeeze(mean: np.ndarray, weight: np.ndarray, compression: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids merged so that each spans at most one step of the scale, which is finest at both ends."""
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    middle = (np.cumsum(weight) - weight / 2) / weight.sum()
    cell = np.floor(compression * (np.arcsin(2 * np.clip(middle, 0, 1) - 1) / np.pi + 0.5)).astype(int)
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    total = np.add.reduceat(weight, start)
    return np.add.reduceat(mean * weight, start) / total, total


def digest_merge(digests: DataFrame, compression: int = 100) -> DataFrame:
    """Digests of equal key as one."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        mean, weight = squeeze(p["mean"].to_numpy(), p["weight"].to_numpy(), compression)
        return pd.DataFrame({"key": [p["key"].iloc[0]] * len(mean), "mean": mean, "weight": weight, "min": p["min"].min(), "max": p["max"].max()})

    return digests.groupBy("key").applyInPandas(run, digests.schema)


def digest_quantile(digests: DataFrame, qs: list[float]) -> DataFrame:
    """Quantiles ``q0``, ``q1`` ... of each digest, between the middles of its centroids by straight lines, and its extremes at the ends."""
    w = Window.partitionBy("key").orderBy("mean", "weight")
    at = (F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight") / 2) / F.sum("weight").over(Window.partitionBy("key"))
    rows = digests.withColumn("_at", at)
    rows = rows.withColumns({"_before": F.coalesce(F.lag("_at").over(w), F.lit(0.0)), "_from": F.coalesce(F.lag("mean").over(w), F.col("min"))})
    cols = []
    for i, q in enumerate(qs):
        inside = (F.col("_before") <= q) & (F.col("_at") > q)
        value = F.col("_from") + (F.col("mean") - F.col("_from")) * (q - F.col("_before")) / (F.col("_at") - F.col("_before"))
        last = F.max(F.struct("_at", "mean", "max"))
        end = last["mean"] + (last["max"] - last["mean"]) * (q - last["_at"]) / F.greatest(1 - last["_at"], F.lit(1e-12))
        cols.append(F.coalesce(F.max(F.when(inside, value)), end).alias(f"q{i}"))
    return rows.groupBy("key").agg(*cols)


def cdf(rows: DataFrame, x: float, value: str = "value") -> DataFrame:
    """Share of the values of each key that are at most x."""
    return rows.groupBy("key").agg(F.avg(F.when(F.col(value) <= x, 1.0).otherwise(0.0)).alias("cdf"))


def digest_info(rows: DataFrame, value: str = "value") -> DataFrame:
    return rows.groupBy("key").agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))


def trimmed_mean(rows: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    """Mean of the values of each key between two quantiles."""
    bounds = quantiles(rows, [low, high], value, exact=True)
    return rows.join(bounds, "key").where(F.col(value).between(F.col("q0"), F.col("q1"))).groupBy("key").agg(F.avg(value).alias("mean"))
