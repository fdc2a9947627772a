"""Structured Streaming forms: live entries, windows, channels, consumer groups, queues and deadlines."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.shipping import ship
from ..sources.tables import shared


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the rows of Parquet files; the schema comes from those that are there."""
    schema = spark.read.parquet(path).schema
    glob = path.removesuffix(".parquet") + ".parquet*"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(glob)


def run_available(out: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there now and return its result (for tests and backfills).

    The result is written as Parquet beside the query's checkpoint and never
    passes through the driver: appended by batch, or in mode ``complete`` the
    last batch's.
    """
    spark = out.sparkSession
    place = shared(spark, "live")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{place}/out").start().awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{place}/out")
    made: list[str] = []

    def deliver(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out-{number}")
        made[:] = [f"{place}/out-{number}"]

    writer.foreachBatch(deliver).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(made[0]) if made else spark.createDataFrame([], out.schema)


def _windowed(events: DataFrame, ts: str, window: Column, late: str, by: list[str], aggregates: tuple, ends: tuple[str, ...] = ("start",)) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(window.alias("_w"), *by).agg(*aggregates)
    return out.select(*[F.col(f"_w.{e}").alias(e) for e in ends], *[c for c in out.columns if c != "_w"])


def tumble(events: DataFrame, ts: str, width: str, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of fixed windows; events later than the watermark are left out."""
    return _windowed(events, ts, F.window(F.col(ts), width), late, by, aggregates)


def slide(events: DataFrame, ts: str, width: str, step: str, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """As ``tumble`` with windows that begin at every step."""
    return _windowed(events, ts, F.window(F.col(ts), width, step), late, by, aggregates)


def sessions(events: DataFrame, ts: str, gap: str, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of sessions that end after a gap."""
    return _windowed(events, ts, F.session_window(F.col(ts), gap), late, by, aggregates, ("start", "end"))


def subscribe(messages: DataFrame, channels: list[str]) -> DataFrame:
    """Messages (channel, ...) of some channels."""
    return messages.where(F.col("channel").isin(channels))


def publish(messages: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """Start a query that hands each batch of messages to a function."""
    return messages.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).start()


def consumer_groups(entries: DataFrame, consumers: int) -> DataFrame:
    """Deals the entries (key, ms, seq) of each stream to consumers in turn and keeps the cursor of each stream.

    Returns ``key``, ``consumer``, ``given`` (entries given to it in this
    batch) and ``last_ms``, ``last_seq``, the cursor after it. One stream is
    handled by one task, in order; entries at or before the cursor are not
    given again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ms, seq, turn = state.get if state.exists else (-1, -1, 0)
        parts = [np.stack([p["ms"].to_numpy(np.int64), p["seq"].to_numpy(np.int64)]) for p in batches]
        rows = np.concatenate([np.empty((2, 0), np.int64), *parts], axis=1)
        del parts
        rows = rows[:, (rows[0] > ms) | ((rows[0] == ms) & (rows[1] > seq))]
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        given = rows.shape[1] - int((rows[:, 1:] == rows[:, :-1]).all(axis=0).sum())
        # Consumers take turns from the one whose turn it is; an id that is there twice is given once.
        counts = {c: -(-(given - (c - turn) % consumers) // consumers) for c in range(consumers) if (c - turn) % consumers < given}
        if given:
            ms, seq, turn = int(rows[0, -1]), int(rows[1, -1]), turn + given
        state.update((ms, seq, turn))
        if counts:
            yield pd.DataFrame({"key": [key[0]] * len(counts), "consumer": list(counts), "given": list(counts.values()), "last_ms": [ms] * len(counts), "last_seq": [seq] * len(counts)})

    return entries.groupBy("key").applyInPandasWithState(step, "key string, consumer long, given long, last_ms long, last_seq long", "ms long, seq long, turn long", "append", GroupStateTimeout.NoTimeout)


def expiring(writes: DataFrame, ttl_ms: int) -> DataFrame:
    """Last value of each key (key, value, ts) that no later event time, so far as the stream has come, has outlived.

    A key's state goes when the watermark passes its deadline.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [None], "event": ["expired"]})
            return
        best = state.get if state.exists else (-1, None)
        for p in batches:
            for at, v in zip(p["ts"], p["value"], strict=True):
                best = max(best, (int(pd.Timestamp(at).timestamp() * 1000), None if v is None else str(v)), key=lambda x: x[0])
        state.update(best)
        state.setTimeoutTimestamp(max(best[0] + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "value": [best[1]], "event": ["set"]})

    return writes.withWatermark("ts", "0 seconds").groupBy("key").applyInPandasWithState(step, "key string, value string, event string", "at long, value string", "append", GroupStateTimeout.EventTimeTimeout)


#: What a waiting pop takes: the oldest value, the newest, or that of the least or largest score.
TAKES = ("first", "last", "min", "max")


def queue(events: DataFrame, take: str = "first") -> DataFrame:
    """Blocking pops: pushes (kind ``push``, value) meet waiting pops (kind ``pop``, value names who waits), pops first come first served.

    Events (key, n, kind, value and, for ``min`` and ``max``, score) are taken
    by ``n`` within a batch; what waits is kept for later batches. ``take``
    says which value goes: ``first`` (BLPOP of values pushed at the tail),
    ``last`` (BRPOP), ``min`` or ``max`` (BZPOPMIN, BZPOPMAX; ties by value).
    A key is served by one task, in order. A batch of it is held as Arrow
    columns and what waits as bits, some 100 bytes to an event at most.
    """
    if take not in TAKES:
        raise ValueError(f"take must be one of {TAKES}")
    ship(events.sparkSession)
    scored = take in ("min", "max")
    events = events.select("key", "n", "kind", F.col("value").cast("string").alias("value"), F.col("score").cast("double").alias("score") if scored else F.lit(0.0).alias("score"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Rows are never moved: what waits from before comes first, and all orders are arrays of places of rows.
        items, names = (_unpacked(x) for x in state.get) if state.exists else (_NOTHING, _NOTHING)
        had, waited = items.num_rows, names.num_rows
        rows = pa.concat_tables([items, names, *(_arrow(p, scored) for p in batches)]).combine_chunks()
        del items, names
        flags = rows["push"].to_numpy().astype(np.uint8)
        flags[:had] = 1
        order = _places(pc.sort_indices(rows, [(c, "ascending") for c in ("n", "push", "value", "score")]))
        rows = rows.select(["value", "score"])
        order = np.concatenate([np.arange(had + waited, dtype=order.dtype), order[order >= had + waited]])
        sequence, pushes, pops = flags[order[had + waited :]].tobytes(), order[flags[order] == 1], order[flags[order] == 0]
        del order
        # What goes first has the least rank; pops are served in their order, so only the ranks they get are noted.
        by_rank = pushes if take == "first" else pushes[::-1] if take == "last" else _places(pc.sort_indices(rows, [(c, "ascending" if take == "min" else "descending") for c in ("score", "value")]))
        by_rank = by_rank if len(by_rank) == len(pushes) else by_rank[flags[by_rank] == 1]
        rank = np.empty(len(flags), by_rank.dtype)
        rank[by_rank] = np.arange(len(by_rank), dtype=by_rank.dtype)
        ranks = memoryview(rank[pushes])
        del flags, rank
        got, free = array("q"), _Least(len(pushes))
        at, arrived, there = had, waited, had
        for i in range(had):
            free.add(ranks[i])
        for flag in sequence:
            if not flag:
                arrived += 1
                if there:
                    got.append(free.pop())
                    there -= 1
            else:
                if arrived > len(got):
                    got.append(ranks[at])
                else:
                    free.add(ranks[at])
                    there += 1
                at += 1
        ids = by_rank[np.frombuffer(got, np.int64)]
        left = np.ones(len(rows), bool)
        left[ids] = False
        del ranks, by_rank, sequence, free, got
        state.update((_packed(rows, pushes[left[pushes]]), _packed(rows, pops[len(ids) :])))
        del left, pushes
        pa.default_memory_pool().release_unused()
        for start in range(0, len(ids), OUT_ROWS):
            value, who = (rows["value"].take(pa.array(x[: len(ids)][start : start + OUT_ROWS])).to_pylist() for x in (ids, pops))
            yield pd.DataFrame({"key": [key[0]] * len(who), "who": who, "value": value})

    return events.groupBy("key").applyInPandasWithState(step, "key string, who string, value string", "items binary, waiting binary", "append", GroupStateTimeout.NoTimeout)


#: Rows of a batch that ``queue`` hands on.
OUT_ROWS = 1 << 13

_EVENT = pa.schema([("n", pa.int64()), ("push", pa.int8()), ("value", pa.large_string()), ("score", pa.float64())])
_NOTHING = _EVENT.empty_table()


def _arrow(p: pd.DataFrame, scored: bool) -> pa.Table:
    score = p["score"].to_numpy(np.float64) if scored else np.zeros(len(p))
    return pa.table([pa.array(p["n"], pa.int64()), pa.array((p["kind"] == "push").to_numpy(np.int8)), pa.array(p["value"], pa.large_string(), from_pandas=True), pa.array(score)], schema=_EVENT)


def _places(x: pa.Array) -> np.ndarray:
    return x.to_numpy().astype(np.int32 if len(x) < 1 << 31 else np.int64)


def _packed(rows: pa.Table, places: np.ndarray) -> bytes:
    """Waiting rows as one compressed value of the state, without an object for each."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for start in range(0, len(places), OUT_ROWS):
            w.write_table(rows.take(pa.array(places[start : start + OUT_ROWS])))
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    """Rows of the state as events; their order is that of their places, so ``n`` says nothing."""
    rows = pa.ipc.open_stream(bytes(data)).read_all()
    return pa.table([pa.repeat(pa.scalar(0, pa.int64()), len(rows)), pa.repeat(pa.scalar(0, pa.int8()), len(rows)), *rows.columns], schema=_EVENT)


class _Least:
    """A set of whole numbers under ``size`` that gives its least, as bits in levels of words: each bit says whether a word below has any."""

    def __init__(self, size: int) -> None:
        self.levels: list[list[int]] = []
        while not self.levels or size > 1:
            size = (size + 63) >> 6
            self.levels.append([0] * max(size, 1))

    def add(self, x: int) -> None:
        for words in self.levels:
            at = x >> 6
            word = words[at]
            words[at] = word | 1 << (x & 63)
            if word:
                return
            x = at

    def pop(self) -> int:
        x = 0
        for words in reversed(self.levels):
            word = words[x]
            x = x << 6 | (word & -word).bit_length() - 1
        at = x
        for words in self.levels:
            at, bit = at >> 6, at & 63
            words[at] ^= 1 << bit
            if words[at]:
                break
        return x


def moved(popped: DataFrame, target: str) -> DataFrame:
    """What ``queue`` gave as pushes to another list (BLMOVE): key, value and who asked."""
    return popped.select(F.lit(target).alias("key"), "value", "who")
