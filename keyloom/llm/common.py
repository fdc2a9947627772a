"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ship as send

#: Rows and bytes of one Arrow batch; a batch of long texts ends by its bytes.
ARROW_ROWS, ARROW_BYTES = 10_000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, and bound what they get at once."""
    send(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, that of ``spark.checkpoint.dir``.

    Where none is set a temporary folder serves on a local master; a cluster
    without one is an error, as executors don't see each other's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="keyloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, arrow: pa.Schema, binary: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``rows`` to the tuples of each partition, through Arrow batches.

    ``rows`` gets an iterator over the input rows and gives output rows one by
    one, so that memory holds a batch and not a partition; batches end by rows
    or bytes on both sides. Columns in ``binary`` arrive as bytes (strings as
    their UTF-8).
    """
    ship(df.sparkSession)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for b in batches:
                cols = [c.cast(pa.binary()) if n in binary and not pa.types.is_binary(c.type) else c for n, c in zip(b.schema.names, b.columns, strict=True)]
                yield from zip(*[c.to_pylist() for c in cols], strict=True)

        out: list[tuple] = []
        size = 0
        for r in rows(read()):
            out.append(r)
            size += sum(8 * len(x) if isinstance(x, list) else len(x) for x in r if isinstance(x, str | bytes | list))
            if len(out) >= ARROW_ROWS or size >= ARROW_BYTES:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    return df.mapInArrow(run, schema)


def free(columns: list[str], *names: str) -> list[str]:
    """For each of ``names`` itself with as many _ before it as no column has that name (case apart)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
