"""SimHash near-duplicates (operator 6), by the generalised pigeonhole principle.

Fingerprints within ``TAU`` bits are linked. The 64 bits are dealt into m
groups, correlated bits together, and each group gets a threshold of its
own, -1 (not probed) or more, with a sum of TAU - m + 1: two fingerprints
within TAU bits are then within the threshold on one group at least. The
thresholds and m are those with the least estimated number of candidates,
found by dynamic programming over bit statistics of all fingerprints.
Candidates share a key (a group's bits, with up to the threshold of them
flipped) and are verified within their bucket.

Buckets of more than ``BUCKET`` fingerprints are not compared pairwise.
Their fingerprints meet in the places one bit around them instead: two are
within two bits exactly if they share such a place, and no place has more
than 65 fingerprints around it. So no link is lost and no group makes a
square of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, map_rows
from .components import components

TAU = 2
SHINGLE, SEED = 3, 42
#: Fingerprints of a bucket that are compared pairwise; larger buckets go the other way.
BUCKET = 128
#: Numbers of groups that are weighed against each other.
GROUPS = (2, 3, 4)
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 without words.

    Words lie between ASCII white space, A-Z lower-cased; shingles count as
    often as they occur; a bit is 1 if set in over half of their hashes.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (long) of every row; a null text counts as empty."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return map_rows(kept, lambda it: ((k, simhash(t, shingle)) for k, t in it), "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))


def _together(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64), np.int64)
        for b in batches:
            x = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int64()), pa.array([n, *both.ravel().tolist()], pa.int64())], names=["i", "n"])

    got = {r["i"]: r["n"] for r in fps.select("fp").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return got.get(0, 0), np.array([got.get(i + 1, 0) for i in range(4096)], float).reshape(64, 64)


def plan(n: int, both: np.ndarray, tau: int = TAU, sizes: tuple[int, ...] = GROUPS, most: int = 1) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, those of -1 left out, of the least estimated cost.

    ``sizes`` are the numbers of groups to weigh, ``most`` the largest threshold.
    """
    bits = len(both)
    p11 = both / max(n, 1)
    p = np.diag(p11)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    phi = np.abs(p11 - np.outer(p, p)) / np.outer(sd, sd)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    agree2 = p11**2 + p10**2 + p01**2 + np.maximum(1 - p11 - p10 - p01, 0) ** 2
    agree = p**2 + (1 - p) ** 2
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in sizes:
        groups: list[list[int]] = []
        left = set(range(bits))
        for k in range(m):
            size = (bits - sum(map(len, groups))) // (m - k)
            group = [max(left, key=lambda i: (phi[i, list(left)].sum(), -i))]
            left.remove(group[0])
            while len(group) < size:
                group.append(max(left, key=lambda i: (phi[i, group].max(), -i)))
                left.remove(group[-1])
            groups.append(group)
        cost: list[dict[int, float]] = []
        for g in groups:
            near = np.zeros(tau + 1)
            near[0] = 1
            for at, i in enumerate(g):
                j = max(g[:at], key=lambda j: phi[i, j]) if at else -1
                q = min(1.0, agree2[i, j] / agree[j]) if at else agree[i]
                near = near * q + np.concatenate([[0], near[:-1]]) * (1 - q)
            ball = [1, 1 + len(g), 1 + len(g) + len(g) * (len(g) - 1) // 2]
            cost.append({-1: 0.0} | {t: n * ball[t] + n * n / 2 * near[: t + 1].sum() for t in range(min(most, tau) + 1)})
        sums: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in cost:
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (x, ts) in sums.items():
                for t, y in c.items():
                    if s + t not in new or x + y < new[s + t][0]:
                        new[s + t] = (x + y, [*ts, t])
            sums = new
        x, ts = sums[tau - m + 1]
        if x < best[0]:
            best = (x, [(sorted(g), t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _verified(rows: DataFrame) -> DataFrame:
    """Links that join the fingerprints of each bucket (group, key; rows of one bucket together) within TAU bits."""

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        def linked(fps: list[int]) -> Iterator[tuple[int, int]]:
            fps = sorted(set(fps))
            if len(fps) < 2:
                return
            x = np.array(fps, np.int64).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= TAU
            label = np.arange(len(x))
            while True:
                new = np.where(near, label, len(x)).min(axis=1)
                if (new == label).all():
                    break
                label = new
            for i in np.flatnonzero(label != np.arange(len(x))).tolist():
                yield fps[i], fps[label[i]]

        key, held = None, []
        for g, k, fp in it:
            if (g, k) != key:
                yield from linked(held)
                key, held = (g, k), []
            held.append(fp)
        yield from linked(held)

    return map_rows(rows, run, "u long, v long", _EDGE)


def _keys(group: int, bits: list[int], threshold: int) -> Column:
    """Array of a group's keys of a fingerprint: its bits, and with threshold 1 also each of them flipped."""
    own = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
    flips = [own.bitwiseXOR(F.lit(_mask([b]))) for b in bits] if threshold else []
    return F.array(*[F.struct(F.lit(group).alias("g"), k.alias("key")) for k in (own, *flips)])


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between different fingerprints (column ``fp``, distinct) that join all those within TAU bits."""
    n, both = _together(fps)
    keys = [_keys(g, bits, t) for g, (bits, t) in enumerate(plan(n, both))]
    if not keys:
        return fps.sparkSession.createDataFrame([], "u long, v long")
    probes = fps.select("fp", F.explode(F.concat(*keys)).alias("x")).select("x.g", "x.key", "fp")
    shared = probes.groupBy("g", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(probes.join(shared, ["g", "key"]))
    small = met.where(F.col("n") <= BUCKET).select("g", "key", "fp")
    large = met.where(F.col("n") > BUCKET).select("fp").distinct()
    around = large.select("fp", F.explode(F.concat(F.array("fp"), F.transform(F.array(*[F.lit(_mask([b])) for b in range(64)]), lambda x: F.col("fp").bitwiseXOR(x)))).alias("place"))
    least = around.groupBy("place").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.explode("fps").alias("u"), F.array_min("fps").alias("v"))
    return _verified(small.repartition("g", "key").sortWithinPartitions("g", "key")).union(least.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (long) and ``component_id`` of every row.

    ``component_id``: the least id that can be reached over links, the row's
    own included; null only where all those ids are null. Texts that are
    null, empty or without words have fingerprint zero, which is linked like
    any other. Repeated rows give repeated results; other columns are not
    read. Only fingerprints and ids are shuffled, never texts.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(fps))
    joined = cut(fps.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = cut(joined.join(least, "root").select("fp", "component_id"))
    return marked.join(ids, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component in ``found`` (doc_id, component_id).

    One row is kept for each such id; a row with a null id is kept where its
    component has no id.
    """
    (name,) = free(docs.columns, "_kept")
    kept = cut(found.where("doc_id <=> component_id").groupBy("doc_id").agg(F.count("*").alias("n")))
    repeated = kept.where("n > 1").limit(1).count() > 0
    out = docs.join(kept.select(F.col("doc_id").alias(name)).hint("shuffle_hash"), F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")
    return out.dropDuplicates([id_col]) if repeated else out
