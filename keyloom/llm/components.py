"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _contract(edges: DataFrame) -> DataFrame:
    """Within each partition, replace the links by a star for each local component (union-find)."""

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in it:
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        for x in list(up):
            if (r := root(x)) != x:
                yield x, r

    return map_rows(edges.select("u", "v"), rows, "u long, v long", _EDGE)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (u, v: long), root the least node it can reach, itself left out.

    Links are first contracted within partitions; then large-star and
    small-star rounds alternate until nothing changes, a number of rounds
    that grows with the logarithm of the longest path. Each round joins the
    links with one minimum for each node, which is aggregated and written
    before the join: both sides of the join are then plain shuffles, and Spark
    splits the partition of a node with very many links over tasks. A round
    ends in a checkpoint in the shared folder.
    """
    e = cut(_contract(edges.where("u <> v")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = cut(e.groupBy("u").agg(F.min("v").alias("m")))
        joined = e.join(least, "u")
        e = cut(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
