"""Where rows belong: ids that rise with time, a ring of hashed nodes, slots dealt evenly to nodes."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First millisecond of the ids, and the bits of node and sequence below the time (fixed values).
EPOCH, NODE_BITS, SEQUENCE_BITS = 1288834974657, 12, 10


def ids(rows: DataFrame, node: int, ms: str = "ms", order: str = "n") -> DataFrame:
    """The rows with ``id``: milliseconds since EPOCH, the node, and a number within the millisecond.

    Rows of one millisecond are numbered by ``order``; more than 1,024 of them
    go on in the next, as a clock would wait, so ids stay unique only while
    the rows that follow leave room.
    """
    w = Window.partitionBy(ms).orderBy(order)
    n = F.row_number().over(w) - 1
    at = F.col(ms) - EPOCH + F.floor(n / (1 << SEQUENCE_BITS))
    low = F.lit((node & ((1 << NODE_BITS) - 1)) << SEQUENCE_BITS).cast("long") + n % (1 << SEQUENCE_BITS)
    return rows.withColumn("id", (at * (1 << (NODE_BITS + SEQUENCE_BITS)) + low).cast("long"))


def ring(nodes: list[str], replicas: int) -> list[tuple[int, str]]:
    """Points of the nodes on a ring, in order; where two nodes meet the later one counts."""
    return sorted({zlib.crc32(f"{i}{n}".encode()): n for n in nodes if n for i in range(replicas)}.items())


def node_of(key: Column, points: list[tuple[int, str]]) -> Column:
    """The node of the first point at or after a key's hash, around the ring; of a key with ``{tag}`` the tag is hashed.

    The points are few and written into the plan; they are searched by halving.
    """
    if not points:
        return F.lit(None).cast("string")
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    h = F.crc32(F.when(tag != "", tag).otherwise(key).cast("binary"))
    at, names = F.array(*[F.lit(p).cast("long") for p, _ in points]), F.array(*[F.lit(n) for _, n in points])

    def search(x: Column) -> Column:
        def step(a: Column, _: Column) -> Column:
            mid = F.shiftright(a["low"] + a["high"], 1)
            under = F.get(x["at"], mid) < x["h"]
            return F.when(a["low"] >= a["high"], a).otherwise(F.struct(F.when(under, mid + 1).otherwise(a["low"]).alias("low"), F.when(under, a["high"]).otherwise(mid).alias("high")))

        start = F.struct(F.lit(0).alias("low"), F.lit(len(points)).alias("high"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(points).bit_length())), start, step, lambda a: F.get(x["names"], a["low"] % len(points)))

    return F.transform(F.array(F.struct(at.alias("at"), names.alias("names"), h.alias("h"))), search)[0]


def rebalance(slots: DataFrame, nodes: list[str]) -> DataFrame:
    """Slots (slot, node) dealt anew so that no node has more than one slot more than another.

    A node keeps its first slots up to its share; only the rest move, and
    slots of nodes that are gone. Returns ``slot``, ``node`` and ``old``.
    """
    own = slots.where(F.col("node").isin(nodes))
    n = slots.count()
    base, more = divmod(n, len(nodes))
    held = {r["node"]: r["count"] for r in own.groupBy("node").count().collect()}
    # The nodes that hold most get the shares that are one larger, so that fewer slots move.
    by_size = sorted(nodes, key=lambda x: (-held.get(x, 0), x))
    share = {x: base + (i < more) for i, x in enumerate(by_size)}
    table = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    numbered = slots.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("slot")))
    stays = F.col("node").isin(nodes) & (F.col("_n") <= table[F.col("node")])
    kept = numbered.where(stays).select("slot", "node", F.col("node").alias("old"))
    # A node takes a run of the free slots in order; the plan has a bound for each node, not an entry for each slot.
    to, end = F, 0
    for x in nodes:
        if more := share[x] - min(held.get(x, 0), share[x]):
            end += more
            to = to.when(F.col("_k") <= end, x)
    if not end:
        return kept
    free = numbered.where(~F.coalesce(stays, F.lit(False))).withColumn("_k", F.row_number().over(Window.orderBy("slot")))
    return kept.unionByName(free.select("slot", to.alias("node"), F.col("node").alias("old")))
