"""URL filters (operator 10): rules, then a blocked Bloom filter before an exact hash join.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free

#: Bits of the filter for each listed URL, and bits of a block (four words of 64).
BITS_PER_URL, BLOCK_BITS = 16, 256
#: Blocks at most: 32 MB, which bounds what is sent to every executor. A longer list lets more false hits through to the exact join.
MAX_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host and path of a rule.
Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to /, ?, # or the end, with A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def _without_dots(path: Column) -> Column:
    """The segments of a path, those of ``.`` left out and those of ``..`` with the one before them."""

    def step(kept: Column, s: Column) -> Column:
        return F.when(s == ".", kept).when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def canonical(host: Column, path: Column) -> Column:
    """One form for the URLs of a page, without scheme, query and fragment.

    Of the host: user names, the ports 80 and 443 and dots at its end are
    left out. Of the path: bytes written with % are read (a slash stays
    written), segments of dots are followed, slashes count once and none at
    the end.
    """
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "[.]*(:(80|443)?)?$", "")
    kept = F.regexp_replace(F.regexp_replace(path, "%2[Ff]", "%252F"), "[+]", "%2B")
    path = F.when(path.contains("%"), F.coalesce(F.try_url_decode(kept), path)).otherwise(path)
    path = F.when(path.rlike(r"/[.]{1,2}(/|$)"), _without_dots(path)).otherwise(path)
    return F.concat(host, F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of rule text and verdict of the longest rule that fits (ties: the longer host, then by text), or null."""
    found: Column = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))[::-1]:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def _words(key: Column) -> list[Column]:
    """Two bits in each of the four words of a block."""
    h = F.xxhash64(key, F.lit("bits"))

    def bit(k: int) -> Column:
        return F.shiftrightunsigned(h, 5 * k).bitwiseAND(F.lit(31)).cast("int")

    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit(2 * w)).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(2 * w + 1) + 32)) for w in range(4)]


def bloom(listed: DataFrame, key: str) -> tuple[Column, int]:
    """A blocked Bloom filter of a column as a scalar subquery (array of words), and its number of blocks.

    The filter is made once and written, one row; what reads it is a scan.
    """
    n = listed.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * BLOCK_BITS < n * BITS_PER_URL:
        blocks *= 2
    spark = listed.sparkSession
    own = listed.select(_block(F.col(key), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col(key)))])
    own = own.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])
    dense = spark.range(blocks).select(F.col("id").cast("int").alias("block")).join(own, "block", "left")
    rows = dense.select(F.struct("block", F.array(*[F.coalesce(f"w{i}", F.lit(0).cast("long")) for i in range(4)]).alias("w")).alias("x"))
    return rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"])).alias("words")).transform(cut).scalar(), blocks


def maybe_listed(key: Column, words: Column, blocks: int) -> Column:
    """Whether the filter may hold the key: no false negatives."""
    base = _block(key, blocks) * 4
    hit = F.lit(True)
    for i, w in enumerate(_words(key)):
        hit = hit & (F.get(words, base + i).bitwiseAND(w) == w)
    return hit


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url") -> DataFrame:
    """The input rows with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: (verdict, host, path), few, written into the plan; a rule fits
    its host and all subdomains where the path starts with the rule's, and
    the longest decides. Without a rule the list decides: ``listed`` has one
    column of canonical URLs (see ``canonical``; nulls and repeated rows do
    no harm), and a listed URL is blocked, any other allowed. Only URLs that
    pass the filter take part in the exact join.

    A null URL or one without ``://`` has empty host and path, no rule, and is
    allowed. Input columns named host, path, rule or verdict are replaced, all
    others are kept, whatever their names.
    """
    out = ("host", "path", "rule", "verdict")
    ruled, key, maybe, match = free([*pages.columns, *out], "_rule", "_key", "_maybe", "_listed")
    keys = cut(listed.select(F.col(listed.columns[0]).alias(match)).where(F.col(match).isNotNull()).distinct())
    words, blocks = bloom(keys, match)
    kept = [pages[f"`{c}`"] for c in pages.columns if c.lower() not in out]
    parts = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumns({ruled: rule_of(F.col("host"), F.col("path"), rules), key: canonical(F.col("host"), F.col("path"))})
    parts = parts.withColumn(maybe, F.col(ruled).isNull() & (F.col(key) != "") & maybe_listed(F.col(key), words, blocks))
    far = parts.where(~F.col(maybe)).withColumn(match, F.lit(None).cast("string"))
    near = parts.where(F.col(maybe)).join(keys, F.col(key) == F.col(match), "left")
    rule = F.col(ruled)
    verdict = F.coalesce(rule["verdict"], F.when(F.col(match).isNotNull(), "block").otherwise("allow"))
    return far.unionByName(near).withColumns({"rule": rule["rule"], "verdict": verdict}).drop(ruled, key, maybe, match)
