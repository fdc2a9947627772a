"""Exact top-k search by inner product (operator 2): KD-trees per shard.

Candidates stream through the tasks in shards of bounded size. Each shard is
cut by median splits into leaves with tight bounding boxes; a query visits
leaves by falling box bound and leaves out those whose bound is under its
kth best score so far. That score is carried from shard to shard, and begins
with the kth score over a bounded sample of the candidates, which is a lower
bound, so that the result stays exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship

#: Vectors of a shard and of a leaf.
SHARD, LEAF = 16_384, 64
#: Queries of one pass over the candidates; their table is broadcast, so it is bounded.
QUERY_BYTES = 32 << 20
#: Candidates at least in the sample from which first kth scores come; it grows with the square root of all.
SAMPLE = 4096
#: Stands for no score; its negative is a 64-bit number too.
NONE = -(1 << 62)


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``v`` (array of long: floor(256 x)); vectors that are null or hold nulls or non-finite components are left out."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, by floating point where that is exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Tree:
    """Leaves of a shard: rows in leaf order, leaf borders, and a tight box for each leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order: list[np.ndarray] = []
        todo = [np.arange(len(rows))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                order.append(at)
                continue
            part = rows[at]
            wide = int((part.max(axis=0) - part.min(axis=0)).argmax())
            half = len(at) // 2
            split = np.argpartition(part[:, wide], half)
            todo += [at[split[:half]], at[split[half:]]]
        self.border = np.cumsum([0] + [len(a) for a in order])
        every = np.concatenate(order)
        self.ids, self.rows = ids[every], rows[every]
        self.low = np.minimum.reduceat(self.rows, self.border[:-1], axis=0)
        self.high = np.maximum.reduceat(self.rows, self.border[:-1], axis=0)

    def search(self, q_ids: np.ndarray, queries: np.ndarray, best: np.ndarray, found: np.ndarray, floor: np.ndarray) -> None:
        """Put better candidates into ``best`` (scores, falling) and ``found`` (their ids).

        ``floor``: a score for each query under which nothing can be among its k best.
        """
        k = best.shape[1]
        bound = _product(np.maximum(queries, 0), self.high) + _product(np.minimum(queries, 0), self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        leaves, done, size = len(self.border) - 1, 0, 1
        active = np.arange(len(queries))
        while done < leaves and len(active):
            batch = order[active, done : done + size]
            for leaf in np.unique(batch):
                who = active[(batch == leaf).any(axis=1)]
                who = who[bound[who, leaf] >= np.maximum(floor[who], best[who, -1])]
                if not len(who):
                    continue
                a, b = self.border[leaf], self.border[leaf + 1]
                score = _product(queries[who], self.rows[a:b])
                score[q_ids[who][:, None] == self.ids[None, a:b]] = NONE
                score[score < floor[who][:, None]] = NONE
                both = np.concatenate([best[who], score], axis=1)
                names = np.concatenate([found[who], np.broadcast_to(self.ids[a:b], score.shape)], axis=1)
                top = np.lexsort((names, -both), axis=1)[:, :k]
                best[who], found[who] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
            done, size = done + size, 2 * size
            if done < leaves:
                active = active[bound[active, order[active, done]] >= np.maximum(floor[active], best[active, -1])]


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _pass(candidates: DataFrame, q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> DataFrame:
    """Each task's k best (query_id, id, score) of these queries, all of one dimension."""
    spark = candidates.sparkSession
    sent = spark.sparkContext.broadcast((q_ids, queries, floor))
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, low = sent.value
        best, found = np.full((len(ids), k), NONE), np.full((len(ids), k), np.iinfo(np.int64).max)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                Tree(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])).search(ids, rows, best, found, low)
                held.clear()

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(b.column(1), b.num_rows)))
            if sum(len(a) for a, _ in held) >= SHARD:
                flush()
        flush()
        at = np.nonzero(best > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]], pa.int64()), pa.array(found[at], pa.int64()), pa.array(best[at], pa.int64())], names=["query_id", "id", "score"])

    return candidates.where(F.size("v") == width).select("id", "v").mapInArrow(run, "query_id long, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest scores of each query over all other rows.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows but those of the query's own id. Returns ``query_id``, ``rank`` (from
    1), ``vec_id`` and ``score``, the inner product of floor(256 x); ties go to
    the smaller id; all rows where there are fewer than k. Rows with a null
    id, or a vector that is null or holds null or non-finite components, take
    no part; vectors meet only those of their own length. Repeated rows are
    candidates and queries only once for each (id, vector); the vectors of one
    query id share its k places, a candidate id that has several vectors may
    take several of them. Other columns are not read. Scores must fit in 64
    bits.

    Queries pass over the candidates in blocks of at most QUERY_BYTES, which
    are broadcast; candidates are not shuffled. The sample that first bounds
    come from is drawn once and written.
    """
    spark = vectors.sparkSession
    ship(spark)
    valid = quantised(vectors, id_col, vec_col)
    repeated = valid.groupBy("id").count().where("count > 1").limit(1).count() > 0
    valid = cut(valid.distinct() if repeated else valid)
    queries = valid.where(F.pmod("id", F.lit(every)) == 0)
    out = None
    for width, n in sorted((r["w"], r["n"]) for r in queries.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()):
        blocks = -(-n * 8 * max(width, 1) // QUERY_BYTES)
        same = queries.where(F.size("v") == width)
        total = valid.where(F.size("v") == width).count()
        wanted = SAMPLE + 4 * math.isqrt(total)
        spot = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, wanted / max(total, 1)) * (1 << 30))
        sample = cut(valid.where((F.size("v") == width) & spot).repartition(max(1, -(-wanted // SHARD))))
        for block in range(blocks):
            own = same.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == block).toArrow()
            if not own.num_rows:
                continue
            q_ids = own.column("id").to_numpy().astype(np.int64)
            rows = _matrix(own.column("v").combine_chunks(), len(q_ids))
            low = {r["query_id"]: r["score"] for r in _ranked(_pass(sample, q_ids, rows, np.full(len(q_ids), NONE), k), k).where(F.col("rank") == k).select("query_id", "score").collect()}
            floor = np.array([low.get(i, NONE) for i in q_ids.tolist()], np.int64)
            found = _pass(valid, q_ids, rows, floor, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, score long")
    return _ranked(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
