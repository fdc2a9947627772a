"""Operators on vectors: table ``kv_vec (id, embedding)``, other columns are metadata; sums are made in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are sent to all tasks at once; more queries take more passes.
QUERY_BYTES = 16 << 20

#: Queries and vectors of one matrix of scores; a task holds one of them at a time.
TILE = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), magnitude(a) * magnitude(b)), F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def normalize(a: Column) -> Column:
    n = magnitude(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def score(a: Column, b: Column, metric: str) -> Column:
    """Larger is nearer: cosine, dot product or the negative Euclidean distance."""
    return {"cosine": lambda: cosine(a, b), "dot": lambda: dot(a, b), "euclidean": lambda: -euclid(a, b)}[metric.lower()]()


def vsadd(log: DataFrame, dimension: int) -> DataFrame:
    """Last vector of each id of a log with ``seq``, with its metadata; those of another dimension are refused."""
    from .strings import last_write

    return last_write(log.where(F.size("embedding") == dimension), "id")


def vsget(table: DataFrame, ids: list[int]) -> DataFrame:
    """Vectors and metadata of some ids."""
    return table.where(F.col("id").isin(ids))


def vsdel(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table without some ids."""
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def vssearch(table: DataFrame, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """The k best ids for one vector: a top-k in each task, merged; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return table.select("id", score(F.col("embedding"), q, metric).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def vsquery(table: DataFrame, ids: list[int] | DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """The k best other ids for each of some stored vectors (a list, or a table of ``id``); ties by id.

    Queries pass over the table in blocks of at most QUERY_BYTES. A block is
    sent to all tasks, which score Arrow batches as matrix products of at most
    TILE queries and vectors and keep the k best of each query; only those are
    shuffled. Vectors meet those of
    their own length; null vectors and ids take no part.
    """
    valid = table.where(F.col("id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    queries = valid.where(F.col("id").isin(ids)) if isinstance(ids, list) else valid.join(ids.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi")
    out = None
    for width, n in sorted((r["w"], r["n"]) for r in queries.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).collect()):
        blocks = -(-n * 8 * max(width, 1) // QUERY_BYTES)
        for block in range(blocks):
            own = queries.where((F.size("embedding") == width) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).toArrow()
            if own.num_rows:
                found = _best(valid.where(F.size("embedding") == width), own, width, k, metric.lower())
                out = found if out is None else out.unionByName(found)
    if out is None:
        out = table.sparkSession.createDataFrame([], "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), np.float64).reshape(-1, width)


def _best(table: DataFrame, queries: pa.Table, width: int, k: int, metric: str) -> DataFrame:
    """Each task's k best (query_id, id, score) of the queries."""
    sent = table.sparkSession.sparkContext.broadcast((queries.column("id").to_numpy(), _matrix(queries.column("embedding"), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = sent.value
        n = max(k, 1)
        best, names = np.full((len(q), n), -np.inf), np.full((len(q), n), np.iinfo(np.int64).max)
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), width)
            for i in range(0, len(q), TILE):
                for j in range(0, len(ids), TILE):
                    own, some = slice(i, i + TILE), ids[j : j + TILE]
                    s = _scores(q[own], x[j : j + TILE], metric)
                    s[np.isnan(s) | (q_ids[own, None] == some[None, :])] = -np.inf
                    _merge(best[own], names[own], s, some)
        at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at[0]]), pa.array(names[at]), pa.array(best[at])], names=["query_id", "id", "score"])

    return table.mapInArrow(run, "query_id long, id long, score double")


def _scores(q: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    s = q @ rows.T
    if metric == "cosine":
        size = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((rows * rows).sum(axis=1))[None, :]
        return np.divide(s, size, out=np.zeros_like(s), where=size != 0)
    return -np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - 2 * s + (rows * rows).sum(axis=1)[None, :], 0)) if metric == "euclidean" else s


def _merge(best: np.ndarray, names: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    """Put into the best scores and names of each query, in order, those of a tile of scores that belong there; ties by id."""
    k = best.shape[1]
    least = best[:, -1] if s.shape[1] <= k else np.maximum(best[:, -1], np.partition(s, -k, axis=1)[:, -k])
    row, column = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    own = np.unique(row)
    query = np.concatenate([np.repeat(own, k), row])
    score, name = np.concatenate([best[own].ravel(), s[row, column]]), np.concatenate([names[own].ravel(), ids[column]])
    order = np.lexsort((name, -score, query))
    top = order[np.searchsorted(query[order], own)[:, None] + np.arange(k)]
    best[own], names[own] = score[top], name[top]


def vsrange(table: DataFrame, query: list[float], metric: str, threshold: float) -> DataFrame:
    """Ids with cosine or dot product at least, or Euclidean distance at most, the threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric.lower() == "euclidean":
        return table.select("id", euclid(F.col("embedding"), q).alias("score")).where(F.col("score") <= threshold)
    return table.select("id", score(F.col("embedding"), q, metric).alias("score")).where(F.col("score") >= threshold)


def centroid(table: DataFrame, by: str) -> DataFrame:
    """Mean of each component of each group: one row for each component."""
    return table.select(by, F.posexplode("embedding").alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))


def vslen(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


vscard = vslen
