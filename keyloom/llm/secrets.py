"""Secret scans (operator 3): fixed patterns, and a battery of randomness tests.

Long runs of letters, digits and a few signs are tested for randomness. The
encoding is inferred from a run's characters, without the signs that join
words. Against written words three tests are made: a chi-squared test of how
evenly the alphabet is used, a runs test on runs of characters of one class
(upper case, lower case, digit), and lag-1 serial correlation of the places in
the alphabet. Their normal scores are summed to one score a run, and the runs
of a document are secrets under control of the false discovery rate, with
longer runs weighing more.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: Kinds of base spans in order, with pattern, group and least length of what must be long enough (fixed values).
#: The patterns of access and hex ask for that length themselves, which finds the same spans as dropping short ones later.
KINDS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Runs that the battery tests, and the kind of the spans it adds.
RUN, RANDOM = r"[A-Za-z0-9+/_-]{20,}", "random"
#: Signs that join words, as in paths and identifiers; the battery looks at what is left without them.
JOINTS = "/_-"
#: Encodings in order of inference: pattern, alphabet, chance that two characters of written words within it are the
#: same, and chance that a character of written words is of another class than the one before it.
ENCODINGS = [
    (r"^[0-9a-f]+$", "0123456789abcdef", 0.26, 0.1),
    (r"^[0-9A-F]+$", "0123456789ABCDEF", 0.26, 0.1),
    (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066, 0.1),
    (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.066, 0.1),
    (r"^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0.066, 0.1),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.066, 0.35),
    (r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+", 0.066, 0.35),
]
#: Lag-1 serial correlation of written words, in which characters of one class stand together.
SERIAL = 0.3
#: Share of false discoveries among the secrets of the battery, in each document.
RATE = 0.01
#: Spans of which the starts are summed up together.
BLOCK = 64
_SPAN = "struct<start:long,rank:int,end:long,value:string>"


def _let(value: Column, then) -> Column:
    """``then(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), then)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(sizes: Column, then) -> Column:
    """``then`` of the function that gives the sum of all ``sizes`` before a place: of whole blocks, and within one."""
    count = F.ceil(F.size(sizes) / BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), count), lambda b: _total(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return _let(F.aggregate(sums, start, step, lambda acc: acc["out"]), lambda upto: then(lambda i: F.get(upto, block(i)) + _total(F.slice(sizes, block(i) * BLOCK + 1, i % BLOCK))))


def _spans(text: Column, pattern: str, rank: int) -> Column:
    """Array of (start, rank, end, value) of the leftmost matches of a pattern."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x: Column) -> Column:
        pairs = F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: F.struct(m.alias("m"), F.length(g).cast("long").alias("g"), (F.length(g) + F.length(m)).cast("long").alias("both")))

        def spans(p: Column) -> Column:
            def one(sums):
                def span(y: Column, i: Column) -> Column:
                    start = sums(i) + y["g"]
                    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(y["m"])).alias("end"), y["m"].alias("value"))

                return F.transform(p["pairs"], span)

            return _before(p["sizes"], one)

        return _let(F.struct(pairs.alias("pairs"), F.transform(pairs, lambda y: y["both"]).alias("sizes")), spans)

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(text.rlike(pattern), _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, within 1e-7 (polynomial 26.2.17 of the Handbook of Mathematical Functions)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    p = F.exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, p).otherwise(1 - p)


def battery(value: Column) -> Column:
    """Struct of the length that is tested, the scores of the three tests and the p-value of their sum against written words."""
    plain = F.translate(value, JOINTS, "")

    def inferred(v: Column) -> Column:
        chosen = F.lit(len(ENCODINGS) - 1)
        for i, (pattern, *_) in reversed([*enumerate(ENCODINGS[:-1])]):
            chosen = F.when(v.rlike(pattern), F.lit(i)).otherwise(chosen)
        table = F.array(*[F.struct(F.lit(a).alias("letters"), F.lit(same).alias("same"), F.lit(change).alias("change")) for _, a, same, change in ENCODINGS])
        return F.struct(v.alias("v"), F.filter(F.split(v, ""), lambda c: c != "").alias("c"), F.get(table, chosen).alias("e"))

    def tested(b: Column) -> Column:
        k, n = F.length(b["e"]["letters"]).cast("double"), F.length(b["v"]).cast("double")
        x = F.transform(b["c"], lambda c: F.call_function("instr", b["e"]["letters"], c).cast("double"))
        squares = F.aggregate(F.transform(F.split(b["e"]["letters"], ""), lambda c: F.when(c == "", 0).otherwise(n - F.length(F.replace(b["v"], c, F.lit(""))))), F.lit(0.0), lambda a, m: a + m * m)
        kinds = F.transform(b["c"], lambda c: F.when(c.between("0", "9"), 0).when(c.between("A", "Z"), 1).when(c.between("a", "z"), 2).otherwise(3))
        return F.struct(n.alias("n"), k.alias("k"), b["e"]["same"].alias("same"), b["e"]["change"].alias("change"), x.alias("x"), kinds.alias("kinds"), squares.alias("squares"))

    def scored(t: Column) -> Column:
        n, k, x = t["n"], t["k"], t["x"]
        excess = n * (k * t["same"] - 1)
        chi = (k - 1 + excess - (t["squares"] * k / n - n)) / F.sqrt(2 * (k - 1 + 2 * excess))
        kinds = t["kinds"]
        changes = F.aggregate(F.zip_with(kinds, F.slice(kinds, 2, F.size(kinds)), lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda a, d: a + F.coalesce(d, F.lit(0.0)))
        runs = (changes - (n - 1) * t["change"]) / F.sqrt((n - 1) * t["change"] * (1 - t["change"]))
        mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n

        def serial(m: Column) -> Column:
            d = F.transform(x, lambda y: y - m)
            return _let(d, lambda d: _let(F.aggregate(d, F.lit(0.0), lambda a, y: a + y * y), lambda square: F.when(square == 0, 1.0).otherwise(F.aggregate(F.zip_with(d, F.slice(d, 2, F.size(d)), lambda a, b: a * b), F.lit(0.0), lambda a, y: a + F.coalesce(y, F.lit(0.0))) / square)))

        order = (SERIAL - _let(mean, serial)) * F.sqrt(n)
        return F.struct(n.alias("n"), chi.alias("chi"), runs.alias("runs"), order.alias("serial"))

    def combined(z: Column) -> Column:
        return F.struct(z["n"].alias("n"), z["chi"].alias("chi"), z["runs"].alias("runs"), z["serial"].alias("serial"), _upper_tail((z["chi"] + z["runs"] + z["serial"]) / 3**0.5).alias("p"))

    return _let(_let(_let(_let(plain, inferred), tested), scored), combined)


def _discovered(runs: Column) -> Column:
    """Runs of a document found by the Benjamini-Hochberg rule, with weights by length."""
    mean = F.aggregate(runs, F.lit(0.0), lambda a, r: a + r["test"]["n"]) / F.size(runs)
    weighed = _let(mean, lambda m: F.array_sort(F.transform(runs, lambda r: F.struct((r["test"]["p"] / (r["test"]["n"] / m)).alias("q"), r["span"].alias("span")))))

    def kept(w: Column) -> Column:
        good = F.array_max(F.filter(F.transform(w, lambda r, i: F.when(r["q"] <= (i + 1) * RATE / F.size(w), r["q"])), lambda q: q.isNotNull()))
        return _let(F.coalesce(good, F.lit(-1.0)), lambda most: F.transform(F.filter(w, lambda r: r["q"] <= most), lambda r: r["span"]))

    return _let(weighed, kept)


def _last_end(spans: Column, before: Column) -> Column:
    """End of the last of ``spans`` (in order, apart) that starts before a place, or 0; found by halving."""
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    middle = lambda a: F.shiftright(a["low"] + a["high"], 1)

    def step(a: Column, _: Column) -> Column:
        under = F.get(spans, middle(a))["start"] < before
        return F.when(a["low"] >= a["high"], a).otherwise(F.struct(F.when(under, middle(a) + 1).otherwise(a["low"]).alias("low"), F.when(under, a["high"]).otherwise(middle(a)).alias("high")))

    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(spans).cast("long"))))
    return F.aggregate(steps, start, step, lambda a: F.when(a["low"] > 0, F.get(spans, a["low"] - 1)["end"]).otherwise(F.lit(0).cast("long")))


def _apart(runs: Column, spans: Column) -> Column:
    """The ``runs`` that meet none of ``spans``."""
    return F.filter(runs, lambda r: _last_end(spans, r["end"]) <= r["start"])


def _long_enough(spans: Column, pattern: str, group: int, least: int) -> Column:
    return F.filter(spans, lambda x: F.length(F.regexp_extract(x["value"], pattern, group)) >= least) if group else spans


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """The input rows with a column ``out``: spans (start, rank, end, value) by start and kind.

    ``rank`` is the place of the kind in KINDS, or that after them for spans
    of the battery, which never overlap the others; start and end are code
    points, end exclusive. A null text counts as empty. Repeated rows are
    kept; an input column of the name ``out`` is replaced, all others are
    kept, whatever their names. Rows are never shuffled.
    """
    names = free([*docs.columns, out], "_text", *[f"_{k}" for k, *_ in KINDS], "_runs", "_tested")
    text, *base, runs, tested = names
    df = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for rank, (name, (_, pattern, group, least)) in enumerate(zip(base, KINDS, strict=True)):
        df = df.withColumn(name, _long_enough(_spans(F.col(text), pattern, rank), pattern, group, least))
    free_runs = F.filter(_spans(F.col(text), RUN, len(KINDS)), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    for name in base:
        free_runs = _apart(free_runs, F.col(name))
    df = df.withColumn(runs, free_runs)
    df = df.withColumn(tested, F.when(F.size(runs) > 0, F.transform(runs, lambda r: F.struct(r.alias("span"), battery(r["value"]).alias("test")))))
    found = F.when(F.size(tested) > 0, _discovered(F.col(tested))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return df.withColumn(out, F.array_sort(F.concat(*base, found))).drop(*names)


def listed(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def _of_kind(spans: Column, rank: int) -> Column:
    return F.filter(spans, lambda s: s["rank"] == rank)


def _without(text: Column, heads: Column, end: Column, mark: str) -> Column:
    """``text`` up to ``end`` as the parts from ``before`` to ``start`` of each head, and all after it, joined by ``mark``.

    A block of heads is cut out of the text at once and its parts out of that.
    """
    cutout = lambda whole, low, high: F.substring(whole, (low + 1).cast("int"), (high - low).cast("int"))

    def block(b: Column) -> Column:
        def parts(x: Column) -> Column:
            low = x["heads"][0]["before"]
            body = F.struct(x["heads"].alias("heads"), low.alias("low"), cutout(text, low, F.element_at(x["heads"], -1)["start"]).alias("body"))
            return _let(body, lambda y: F.array_join(F.transform(y["heads"], lambda h: cutout(y["body"], h["before"] - y["low"], h["start"] - y["low"])), mark))

        return _let(F.struct(F.slice(heads, b * BLOCK + 1, F.lit(BLOCK)).alias("heads")), parts)

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(heads) / BLOCK).cast("int") - 1), block)
    return F.concat(F.array_join(blocks, mark), F.lit(mark), cutout(text, end, F.length(text)))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The input rows with every span of their text, overlapping ones as one, replaced by ``mark``; null stays null.

    All other columns are kept, whatever their names. The spans of a kind lie
    apart, so what lies before a span is found by halving in each kind, and
    the time grows with the number of spans and the length of the text.
    """
    found, heads, *kinds = names = free(docs.columns, "_secrets", "_heads", *[f"_of_{k}" for k, *_ in KINDS], f"_of_{RANDOM}")
    df = scan(docs, text_col, found)
    for rank, name in enumerate(kinds):
        df = df.withColumn(name, _of_kind(F.col(found), rank))

    def gap(s: Column) -> Column:
        return F.struct(F.greatest(*[_last_end(F.col(k), s["start"]) for k in kinds]).alias("before"), s["start"].alias("start"))

    def first(g: Column, i: Column) -> Column:
        return (g["before"] <= g["start"]) & ((i == 0) | (F.get(F.col(found), i - 1)["start"] < g["start"]))

    df = df.withColumn(heads, F.filter(F.transform(found, gap), first))
    end = F.array_max(F.transform(found, lambda s: s["end"]))
    clean = _without(F.col(text_col).cast("string"), F.col(heads), end, mark)
    return df.withColumn(text_col, F.when(F.size(found) > 0, clean).otherwise(F.col(text_col))).drop(*names)
