"""Mixing sources to target weights (operator 7): capped water-filling.

Sources share the words of the whole corpus by weight. One whose share is
more than ``epochs`` times its own words is clamped there and its excess goes
to the others by weight, until none is above. With sources in order of cap
over weight those clamped come first, so running sums give the end of these
rounds at once. Each document is then taken as often as its source's ratio
says: whole repetitions, and one more for those with the smallest seeded
hashes until the source's target is met.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = "mix-1"
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Names of the columns that ``mix`` adds.
OUT = ("size", "source_size", "target", "taken")
#: Hash classes of each source, of which one at most is taken in part.
BINS = 4096


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _digits(key: Column, seed: str, start: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), start, 8), 16, 10).cast("long")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row for each source of ``sized`` (source, size, bin).

    Columns: source, source_size, target, whole (repetitions of every
    document), full_bins (those below are taken once more) and part (share
    taken of the bin that follows).
    """
    bins = cut(sized.groupBy("source", "bin").agg(F.sum("size").alias("size")))
    per = bins.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (number - 1) % len(weights)).cast("long"))
    big = "decimal(38,0)"
    cap = F.col("source_size") * epochs
    before = Window.orderBy((cap.cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(everything),
        "weights": F.sum("weight").over(everything),
        "gone": F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "gone_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    per = per.withColumn("clamped", cap.cast(big) * (F.col("weights") - F.col("gone_weight")).cast(big) < (F.col("total") - F.col("gone")).cast(big) * F.col("weight").cast(big))
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), cap)).over(everything), F.lit(0))
    free_weight = F.col("weights") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("weight"))).over(everything), F.lit(0))
    target = F.when(F.col("clamped"), cap.cast("double")).otherwise(free.cast("double") * F.col("weight") / free_weight)
    per = per.withColumn("target", target).withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
    per = per.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    running = Window.partitionBy("source").orderBy("bin")
    sums = bins.withColumn("upto", F.sum("size").over(running)).withColumnRenamed("source", "_source").withColumnRenamed("size", "bin_size")
    met = per.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("upto") > F.col("rest")), "left")
    first = met.groupBy("source", "source_size", "target", "whole", "rest").agg(F.min(F.struct("bin", "upto", "bin_size")).alias("x"))
    return first.select("source", "source_size", "target", "whole", F.coalesce("x.bin", F.lit(BINS)).alias("full_bins"), F.coalesce((F.col("rest") - (F.col("x.upto") - F.col("x.bin_size"))) / F.col("x.bin_size"), F.lit(0.0)).alias("part"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, whole_documents: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out: tuple[str, str, str, str] = OUT) -> DataFrame:
    """The input rows with the columns of ``out``: size, source_size, target and taken.

    ``taken`` counts the words that the mix takes of the document, repeats
    counted. In a source's last hash class a part of each document is taken,
    or, with ``whole_documents``, each document wholly or not by a second
    hash. Sources are ordered by code point, null last, for the cycle of
    weights. A null text has size 0; null ids share one hash; repeated rows
    are mixed as rows of their own with the same hash; an empty table gives
    an empty result. Input columns of the names in ``out`` are replaced, all
    others are kept. Reruns give the same rows. No document is shuffled unless
    there are more than BROADCAST_SOURCES sources; the result is the same.
    """
    replaced = {n.lower() for n in out}
    bin_name, draw, key, own = free([*docs.columns, *out], "_bin", "_draw", "_source", "_plan")
    bin_of = F.floor(_digits(F.col(id_col), seed, 1) / (2**32 // BINS)).cast("int")
    sized = docs.select(F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), bin_of.alias("bin"))
    per = cut(plan(sized, weights, epochs)).select(F.col("source").alias(key), F.struct("source_size", "target", "whole", "full_bins", "part").alias(own))
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    size = size_of(F.col(text_col)).alias(out[0])
    rows = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in replaced], size, bin_of.alias(bin_name), (_digits(F.col(id_col), seed, 9) / float(2**32)).alias(draw), F.col(source_col).cast("string").alias(f"{key}_of"))
    rows = rows.join(F.broadcast(per) if few else per, F.col(f"{key}_of").eqNullSafe(F.col(key)))
    n, plan_of = F.col(out[0]), F.col(own)
    part = F.when(F.col(draw) < plan_of["part"], n).otherwise(0) if whole_documents else F.floor(n * plan_of["part"])
    extra = F.when(F.col(bin_name) < plan_of["full_bins"], n).when(F.col(bin_name) == plan_of["full_bins"], part).otherwise(0)
    done = rows.withColumns({out[1]: plan_of["source_size"], out[2]: plan_of["target"], out[3]: (n * plan_of["whole"] + extra).cast("long")})
    return done.drop(bin_name, draw, key, f"{key}_of", own)
