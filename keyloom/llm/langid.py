"""Language identification (operator 9).

Multinomial naive Bayes over hashed character n-grams: counts of a labelled
sample give a matrix of log probabilities, one row for each hash bucket and
one column for each language, which is broadcast. A text is counted by bucket
first, piece by piece, so that its length does not matter for memory, and its
sparse counts are multiplied with the rows of their buckets, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import ship

#: Hash buckets, as a power of two.
BITS = 15
#: Lengths of the n-grams.
SIZES = (1, 2, 3, 4)
#: About so many labelled documents of each language are learned from; the choice is by a hash of the id.
SAMPLE_PER_LANGUAGE = 4000
#: Numbers in the matrix that is broadcast (100 MB); with more languages than it has room for there are fewer buckets.
MATRIX = 400 << BITS
#: Characters that are counted at once, and buckets of a batch that are multiplied at once.
PIECE, TERMS = 1 << 16, 1 << 16
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def counts(text: str, bits: int = BITS) -> np.ndarray:
    """How often each bucket occurs: n-grams of the lower-cased letters, other characters part words."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    out = np.zeros(1 << bits, np.int64)
    held = np.array([32], np.uint32)  # what n-grams of the next piece may begin in
    some = False
    for at in range(0, len(text) + 1, PIECE):
        c = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if at + PIECE > len(text):
            c = np.append(c, np.uint32(32))
        c = np.where(_letters[0][c], c, np.uint32(32))
        c = np.concatenate([held[-1:], c])
        c = np.concatenate([held[:-1], c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]])
        some = some or bool((c != 32).any())
        new = len(held)  # n-grams that end before have been counted
        h = np.zeros(len(c), np.uint32)
        for n in range(1, min(max(SIZES), len(c)) + 1):
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1 :]
            first = new - n + 1 if at else (1 - n if n > 1 else 0)
            if n in SIZES and max(first, 0) < len(h):
                out += np.bincount(((h[max(first, 0) :] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
        held = c[-(max(SIZES) - 1) :]
    return out if some else np.zeros(1 << bits, np.int64)


class Model:
    """Languages in order, and a log probability for each bucket and language."""

    def __init__(self, languages: list[str], counted: np.ndarray) -> None:
        self.languages = languages
        self.bits = len(counted).bit_length() - 1
        smooth = counted + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=0, keepdims=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability (equal priors); ``und`` and 0 without letters."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return found
        who: list[int] = []
        sums: list[np.ndarray] = []
        for i, text in enumerate(texts):
            n = counts(text, self.bits) if text else None
            at = np.flatnonzero(n) if n is not None else ()
            if len(at):
                who.append(i)
                step = max(1, TERMS // len(self.languages))
                sums.append(sum(n[at[a : a + step]] @ self.logs[at[a : a + step]] for a in range(0, len(at), step)))
        if who:
            total = np.stack(sums)
            top = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, p in zip(who, total.argmax(axis=1).tolist(), top.tolist(), strict=True):
                found[i] = (self.languages[b], p)
        return found


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn a model from rows with a text and a language.

    ``sample``: about so many rows of each language, chosen by a hash of the
    id, so that reruns learn the same. Rows with null text or language are
    left out; without rows the model has no language and predicts ``und``.
    The driver gets the names of the languages, and at most MATRIX counts,
    as each task's counts are summed by bucket first.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)))
    bits = min(BITS, max(4, (MATRIX // len(languages)).bit_length() - 1))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    least = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))])
    chance = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(chance < least[F.col("lang")]).select(number[F.col("lang")].alias("k"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = counts(text, bits)
                total[k] = total[k] + own if k in total else own
        for k, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int64)), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["k", "bucket", "n"])

    counted = np.zeros((1 << bits, len(languages)))
    got = chosen.mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counted[got.column("bucket").to_numpy(), got.column("k").to_numpy()] = got.column("n").to_numpy()
    return Model(languages, counted)


def identify(docs: DataFrame, model: Model, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The input rows with two columns, named by ``out``: language and posterior (0 to 1).

    ``und`` with score 0 where the text is null or has no letter (or the
    model has no language); ties go to the smaller language name. Input
    columns of the names in ``out`` are replaced, all others are kept; rows
    are kept as they are, repeated ones too. Texts may be of any length: a
    text is counted in pieces and takes no more memory than its own.
    """
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)
    docs = docs.drop(*out)
    names, text = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                part = b.slice(at, 16)
                found = known.value.score(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*names, *out])

    schema = StructType([*docs.schema.fields]).add(out[0], StringType()).add(out[1], DoubleType())
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
