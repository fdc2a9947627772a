"""Document fingerprints (operator 5): one-permutation MinHash.

Each shingle is hashed once; the high bits of the hash name a bin and the
least hash of a bin is its value. Empty bins borrow from a filled one that a
fixed hash of (bin, attempt) names, the same for all documents (optimal
densification). Of each value the low bits are packed into the fingerprint;
likeness corrects for chance agreement of those bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Words of a shingle; a shorter text is one shingle.
SHINGLE = 5
#: Bins, as a power of two, and the low bits kept of each; four make a hex digit.
BIN_BITS, LOW_BITS = 8, 4
BINS = 1 << BIN_BITS
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
ATTEMPTS = 4096
#: Bytes of the input for a task at most, and ranges of ids for each task.
TASK_BYTES, RANGES = 64 << 20, 4
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of _BASE and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        n = max(n, 1 << 17)
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, np.uint64(x))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a UTF-8 text: words between ASCII white space, A-Z lower-cased.

    Differences of one running sum give a polynomial of each word's bytes;
    long texts are cut at white space, so that the sum stays short.
    """
    if len(text) > PIECE:
        out, at = [], 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not _SPACE[text[end]]:
                end += 1
            out.append(_piece(text[at:end]))
            at = end
        return np.concatenate(out)
    return _piece(text)


def _piece(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), np.uint8)
    gap = np.concatenate([[True], _SPACE[b], [True]])
    edge = gap[1:] != gap[:-1]
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    power, inverse = _grow(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])])
    return _mix((sums[end] - sums[start]) * inverse[start])


_donor: list[np.ndarray] = []


def _donors() -> np.ndarray:
    """For each attempt and bin, the bin that it tries."""
    if not _donor:
        _donor.append((_mix(np.arange(ATTEMPTS * BINS, dtype=np.uint64) + np.uint64(BINS)) >> np.uint64(64 - BIN_BITS)).astype(np.intp).reshape(ATTEMPTS, BINS))
    return _donor[0]


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the shingles of a UTF-8 text."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, np.uint64)
    size = min(SHINGLE, len(w))
    h = np.zeros(len(w) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(_BASE) + w[k : k + len(h)]
    return _mix(h)


def fingerprint(text: bytes) -> bytes:
    """Hex digits of the packed low bits of all bins; empty for a text without words."""
    h = np.sort(shingles(text))
    if not len(h):
        return b""
    at = (h >> np.uint64(64 - BIN_BITS)).astype(np.intp)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[at[first]] = h[first]
    filled[at[first]] = True
    empty = np.flatnonzero(~filled) if len(first) > 1 else np.empty(0, np.intp)
    begin, size = 0, max(8, 2 * BINS // len(first))
    while len(empty) and begin < ATTEMPTS:
        donors = _donors()[begin : begin + size, empty]
        tried = filled[donors]
        got, which = tried.any(axis=0), tried.argmax(axis=0)
        values[empty[got]] = values[donors[which[got], got.nonzero()[0]]]
        empty = empty[~got]
        begin += size
    if len(first) == 1:
        values[:] = h[0]
    values[empty] = h[0]
    return _HEX[(values & np.uint64(15)).astype(np.int64)].tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty texts, 0 for one."""
    if not a or not b:
        return float(a == b)
    same = (np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean()
    chance = 0.5**LOW_BITS
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` (hex) of every row; a null text counts as empty."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    arrow = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])
    return map_rows(kept, lambda it: ((k, fingerprint(t).decode()) for k, t in it), "doc_id long, fingerprint string", arrow)


def _parts(docs: DataFrame) -> int:
    """Tasks for a table: those of a shuffle, or more where each would get over TASK_BYTES by Spark's estimate."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // TASK_BYTES, docs.count() // 64))


def _ranges(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """``docs`` with a column ``part``, rising with the id, of ``parts`` parts of about equal size; null ids come last."""
    bounds = sorted({*docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)})
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *bounds, inf] if bounds else [-inf, 0.0, inf], inputCol="_at", outputCol="_part", handleInvalid="keep")
    marked = cut.transform(docs.withColumn("_at", F.col(id_col).cast("double")))
    return marked.withColumn("_part", F.coalesce(F.col("_part"), F.lit(float(len(bounds) + 9))).cast("int")).drop("_at")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by
    the first as many, or all, of the next document by ascending id (ties by
    text, null ids last; after the last comes the first, which for a single
    row is the row itself). A null text counts as empty.

    Texts are shuffled once, by ranges of the id, RANGES to a task, so that
    ranges that meet in one task even out. Tasks grow in number with the
    input. Each range also gets the first document of the next one; the
    driver holds one id for each range. Rows of one id are in one range.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = _parts(plain)
    marked = _ranges(plain, "doc_id", RANGES * parts)
    firsts = sorted((r["_part"], r["least"]) for r in marked.groupBy("_part").agg(F.min("doc_id").alias("least")).collect())
    before = {p: firsts[i - 1][0] for i, (p, _) in enumerate(firsts)}
    ids = [i for _, i in firsts if i is not None]
    is_first = F.col("doc_id").isin(ids) if ids else F.lit(False)
    if any(i is None for _, i in firsts):
        is_first = is_first | F.col("doc_id").isNull()
    halo = marked.where(is_first)
    if before:
        halo = halo.withColumn("_part", F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")])
    both = marked.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
    dealt = both.repartition(parts, "_part").sortWithinPartitions("_part", "_halo", F.col("doc_id").asc_nulls_last(), "text")

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        def pair(key: int, raw: bytes, own: bytes, nxt: bytes, other: bytes) -> tuple:
            text = raw.decode()
            half = len(text) // 2
            edited = (text[: len(text) - half] + nxt[: 4 * half].decode(errors="ignore")[:half]).encode()
            mark = fingerprint(edited)
            return key, len(text), hashlib.sha256(edited).hexdigest(), own.decode(), mark.decode(), likeness(own, mark), likeness(own, other)

        held = None
        for part, is_halo, key, raw in it:
            if held and held[0] != part:
                held = None
            if is_halo and held is None:
                continue
            mark = fingerprint(raw)
            if held:
                yield pair(*held[1:], raw, mark)
            held = None if is_halo else (part, key, raw, mark)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(dealt.select("_part", "_halo", "doc_id", "text"), rows, schema, arrow, binary=("text",))
