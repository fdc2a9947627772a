"""The command log: writes as rows, state as a fold, and its text format.

``command_log (seq, txn, cmd, key, arg, arg2)``. A snapshot is a fold of the
log; compaction writes the snapshot back as a log.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..plans.shipping import ship


def _order() -> WindowSpec:
    return Window.partitionBy("key").orderBy("seq")


def fold_strings(log: DataFrame) -> DataFrame:
    """Values of string keys after SET, SETNX, SETXX, DEL, INCRBY and DECRBY in order of ``seq``.

    SETNX counts where the key does not exist at that time, SETXX where it
    does. The value is that of the last write that counts, plus the changes
    after it. Keys that are deleted at the end are left out. Windows by key
    alone: one shuffle.
    """
    cmd = F.lower("cmd")
    makes = F.when(cmd == "del", False).when(cmd.isin("set", "setnx", "incrby", "decrby"), True)
    log = log.withColumn("_there", F.coalesce(F.last(makes, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    resets = (cmd == "set") | (cmd == "del") | ((cmd == "setnx") & ~F.col("_there")) | ((cmd == "setxx") & F.col("_there"))
    log = log.withColumn("_epoch", F.count(F.when(resets, 1)).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_base", F.when(resets & (cmd != "del"), F.col("arg")))
    delta = F.when(cmd == "incrby", F.col("arg").try_cast("long")).when(cmd == "decrby", -F.col("arg").try_cast("long"))
    last = log.groupBy("key", "_epoch").agg(F.max("_base").alias("base"), F.sum(delta).alias("delta"), F.count(delta).alias("changes"), F.max(F.struct("seq", makes.alias("m"))).alias("_last"), F.max(makes.cast("int")).alias("_made"))
    top = last.groupBy("key").agg(F.max_by(F.struct("base", "delta", "changes", "_made"), "_epoch").alias("x"))
    value = F.when(F.col("x.changes") > 0, (F.coalesce(F.col("x.base").try_cast("long"), F.lit(0)) + F.coalesce("x.delta", F.lit(0))).cast("string")).otherwise(F.col("x.base"))
    return top.where((F.col("x._made") == 1) | F.col("x.base").isNotNull()).select("key", value.alias("value"))


def committed(log: DataFrame) -> DataFrame:
    """The log without transactions (``txn``) of which a command failed (``ok`` false) or which were discarded; null: no transaction."""
    bad = log.where(F.col("txn").isNotNull() & (~F.col("ok") | (F.lower("cmd") == "discard"))).select("txn").distinct()
    return log.join(bad, "txn", "left_anti").where(F.lower("cmd") != "exec")


def watched(log: DataFrame, watches: DataFrame) -> DataFrame:
    """Transactions of ``watches`` (txn, key, watch_seq, exec_seq) in which no watched key was written between the two."""
    hit = watches.join(log.select("key", "seq"), "key").where((F.col("seq") > F.col("watch_seq")) & (F.col("seq") < F.col("exec_seq"))).select("txn").distinct()
    return watches.select("txn").distinct().join(hit, "txn", "left_anti")


def compact(strings: DataFrame) -> DataFrame:
    """The shortest log that gives a snapshot: one SET for each key."""
    return strings.select(F.lit("set").alias("cmd"), "key", F.col("value").alias("arg"), F.xxhash64("key").alias("seq"))


def encode_resp(commands: DataFrame) -> DataFrame:
    """Each command (``args``, array of strings) as an array of bulk strings in the protocol's text, with byte lengths."""
    parts = F.transform("args", lambda a: F.concat(F.lit("$"), F.octet_length(a), F.lit("\r\n"), a, F.lit("\r\n")))
    return commands.withColumn("resp", F.concat(F.lit("*"), F.size("args"), F.lit("\r\n"), F.array_join(parts, "")))


def read_resp(spark: SparkSession, path: str) -> DataFrame:
    """Commands (``path``, ``n``, ``args``) of text log files, in order within each file.

    Arguments are cut by their byte lengths and may hold anything, also line
    breaks and length marks. A command that breaks off at the end of a file is
    left out, as a log that was being written ends so. A file is read as one
    row, so a log is best kept in many files.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in batched(enumerate(decode_resp(content)), 4096):
                    yield _commands(name, part[0][0], [args for _, args in part])

    return files.mapInArrow(run, "path string, n long, args array<string>")


def _commands(path: str, first: int, args: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(args)), pa.array(range(first, first + len(args)), pa.int64()), pa.array(args, pa.list_(pa.string()))], names=["path", "n", "args"])


def decode_resp(data: bytes) -> Iterator[list[str]]:
    """Commands of a log's text, in turn, up to one that breaks off; bytes that are no UTF-8 become marks."""

    def number(at: int, sign: bytes) -> tuple[int, int]:
        end = data.find(b"\r\n", at)
        if end < 0:
            return -1, at
        if data[at : at + 1] != sign or not data[at + 1 : end].isdigit():
            raise ValueError(f"no length mark at byte {at}")
        return int(data[at + 1 : end]), end + 2

    at = 0
    while at < len(data):
        count, at = number(at, b"*")
        args: list[str] = []
        for _ in range(count):
            size, at = number(at, b"$") if at < len(data) else (-1, at)
            if size < 0 or at + size + 2 > len(data):
                return
            args.append(data[at : at + size].decode(errors="replace"))
            at += size + 2
        if count < 0:
            return
        yield args


def snapshot(df: DataFrame, path: str) -> None:
    """Write state as Parquet, to be read by ``spark.read.parquet``."""
    df.write.mode("overwrite").parquet(path)
