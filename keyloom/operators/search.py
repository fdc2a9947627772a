"""Full-text search and its aggregation pipeline.

Documents: ``ft_doc (doc_id, ...)``; postings: ``ft_posting (term, doc_id,
tf, positions)``, one row for each term and document, under the bare term
and, in an index of typed fields, under ``field:term``. Postings are a plan
until they are written: a query on terms filters the words where the texts are
split, before anything is shuffled. An index may be kept as tables, postings
bucketed and sorted by term, so that a query reads a few buckets instead of
the texts. A boolean query is parsed into a tree, whose terms select postings
once; the tree is then a boolean column over one aggregate by document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo as g
from ..functions import text as t


def _words(docs: DataFrame, field: str, stop_words: bool, stem: bool, id_col: str) -> DataFrame:
    """A row (doc_id, pos, term) for each word of a text field."""
    words = t.tokens(F.coalesce(F.col(field), F.lit("")))
    words = t.without_stop_words(words) if stop_words else words
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(words).alias("pos", "term"))
    return rows.withColumn("term", t.stem(F.col("term"))) if stem else rows


def _posted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def postings(docs: DataFrame, field: str, stop_words: bool = True, stem: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Postings of a text field: positions are counted after stop words are left out.

    A term's positions in one document are put together where they are
    exploded, so one row for each term of a document reaches the shuffle, and
    only rows of the terms that are asked for.
    """
    return _posted(_words(docs, field, stop_words, stem, id_col))


def term_counts(docs: DataFrame, field: str, stop_words: bool = True, stem: bool = False, id_col: str = "doc_id", total: bool = True) -> DataFrame:
    """``term``, ``df`` and ``tf``, as ``term_stats`` of the postings of a text field, without making them; ``df`` alone without ``total``.

    The words of a text are told apart in its row, so a task shuffles one row
    for each term it meets. Only rows of ids that are there more than once are
    put together by term and id.
    """
    words = t.tokens(F.coalesce(F.col(field), F.lit("")))
    words = t.without_stop_words(words) if stop_words else words
    words = F.transform(words, t.stem) if stem else words

    def counted(rows: DataFrame) -> DataFrame:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        df = rows.select(F.explode(F.array_distinct(words)).alias("term")).select("term", one.alias("df"), none.alias("tf"))
        return df.unionByName(rows.select(F.explode(words).alias("term")).select("term", none.alias("df"), one.alias("tf"))) if total else df

    repeated = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if repeated.isEmpty():
        out = counted(docs)
    else:
        again = F.col(id_col).eqNullSafe(F.col("_id"))
        more = _words(docs.join(repeated, again, "left_semi"), field, stop_words, stem, id_col).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
        out = counted(docs.join(repeated, again, "left_anti")).unionByName(more.select("term", F.lit(1).cast("long").alias("df"), "tf"))
    return out.groupBy("term").agg(F.sum("df").alias("df"), *([F.sum("tf").alias("tf")] if total else []))


#: Kinds of fields of an index.
KINDS = ("text", "tag", "numeric", "geo")


@dataclass(frozen=True)
class Index:
    """Tables of an index of typed fields: postings, tags (field, tag, doc_id), numbers (field, value, doc_id), places (field, lon, lat, doc_id)."""

    schema: dict[str, str]
    docs: DataFrame
    postings: DataFrame
    tags: DataFrame
    numbers: DataFrame
    places: DataFrame


def build(docs: DataFrame, schema: dict[str, str], id_col: str = "doc_id", stop_words: bool = True) -> Index:
    """An index of the fields in ``schema`` (name to text, tag, numeric or geo; a geo field is a struct of lon and lat).

    Terms of text fields stand under ``field:term`` and, with the counts of
    all fields added up, under the bare term. Null fields have no entries.
    """
    if bad := [k for k in schema.values() if k not in KINDS]:
        raise ValueError(f"no such kind of field: {bad[0]}")
    names = {kind: [f for f, k in schema.items() if k == kind] for kind in KINDS}
    key = F.col(id_col).alias("doc_id")
    spark = docs.sparkSession

    def union(parts: list[DataFrame], empty: str) -> DataFrame:
        out = parts[0] if parts else spark.createDataFrame([], empty)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    if len(names["text"]) == 1:
        # Both names of a term are made before the aggregate, so that a filter on terms comes before its shuffle.
        (field,) = names["text"]
        both = _posted(_words(docs, field, stop_words, False, id_col).withColumn("term", F.explode(F.array(F.col("term"), F.concat_ws(":", F.lit(field), "term")))))
    else:
        per = union([postings(docs, f, stop_words, id_col=id_col).withColumn("field", F.lit(f)) for f in names["text"]], f"term string, doc_id {docs.schema[id_col].dataType.simpleString()}, tf long, positions array<int>, field string")
        both = per.select(F.concat_ws(":", "field", "term").alias("term"), "doc_id", "tf", "positions").unionByName(per.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.flatten(F.collect_list("positions")).alias("positions")))
    kind = docs.schema[id_col].dataType.simpleString()
    tags = union([tag_postings(docs, f, id_col).withColumn("field", F.lit(f)) for f in names["tag"]], f"doc_id {kind}, tag string, field string")
    numbers = union([docs.where(F.col(f).isNotNull()).select(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), key) for f in names["numeric"]], f"field string, value double, doc_id {kind}")
    places = union([docs.where(F.col(f).isNotNull()).select(F.lit(f).alias("field"), F.col(f"{f}.lon").alias("lon"), F.col(f"{f}.lat").alias("lat"), key) for f in names["geo"]], f"field string, lon double, lat double, doc_id {kind}")
    return Index(schema, docs, both, tags, numbers, places)


def keep(index: Index, name: str, buckets: int = 32, id_col: str = "doc_id") -> None:
    """Write an index as tables ``name__*``: postings bucketed and sorted by term, the others sorted by what they are asked by.

    An index of that name must be dropped before; buckets should grow with
    the postings, some 128 MB to each.
    """
    fields = index.docs.sparkSession.createDataFrame([(id_col, "id"), *index.schema.items()], "field string, kind string")
    fields.coalesce(1).write.saveAsTable(f"{name}__fields")
    index.postings.write.bucketBy(buckets, "term").sortBy("term").saveAsTable(f"{name}__postings")
    index.tags.sortWithinPartitions("field", "tag").write.saveAsTable(f"{name}__tags")
    index.numbers.sortWithinPartitions("field", "value").write.saveAsTable(f"{name}__numbers")
    index.places.sortWithinPartitions("field", "lon").write.saveAsTable(f"{name}__places")
    index.docs.write.saveAsTable(f"{name}__docs")


_TABLES = ("fields", "postings", "tags", "numbers", "places", "docs")


def opened(spark: SparkSession, name: str) -> Index:
    """The kept index of a name."""
    t = {k: spark.table(f"{name}__{k}") for k in _TABLES}
    schema = {r["field"]: r["kind"] for r in t["fields"].where("kind <> 'id'").collect()}
    return Index(schema, t["docs"], t["postings"], t["tags"], t["numbers"], t["places"])


def drop(spark: SparkSession, name: str) -> None:
    """Drop a kept index with its tables; none of that name is no error."""
    for k in _TABLES:
        spark.sql(f"drop table if exists {name}__{k}")


def indexes(spark: SparkSession) -> list[str]:
    """Names of the kept indexes, in order."""
    return sorted(t.name.removesuffix("__fields") for t in spark.catalog.listTables() if t.name.endswith("__fields"))


def without(index: Index, gone: DataFrame, id_col: str = "doc_id") -> Index:
    """The index without some documents (column ``doc_id``)."""
    ids = gone.select("doc_id").distinct()
    rest = [t.join(ids, "doc_id", "left_anti") for t in (index.postings, index.tags, index.numbers, index.places)]
    return Index(index.schema, index.docs.join(ids.withColumnRenamed("doc_id", id_col), id_col, "left_anti"), *rest)


def tag_postings(docs: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """Tags (comma-separated values) of a field: ``tag``, ``doc_id``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(t.tags(F.coalesce(F.col(field), F.lit("")))).alias("tag")).distinct()


def term_stats(posting: DataFrame) -> DataFrame:
    """Document and total frequency of each term."""
    return posting.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@dataclass(frozen=True)
class Node:
    """A node of a query: term, prefix, tag (with field), range (of numbers), place, and, or, not."""

    kind: str
    value: str = ""
    parts: tuple[Node, ...] = ()


def parse(query: str) -> Node:
    """A boolean query: words side by side are joined by and, ``|`` is or, ``-`` or NOT is not.

    A part is a word, ``word*``, ``"a phrase"`` (all its words),
    ``@field:word``, ``@field:{tag}``, ``@field:[low high]`` (numbers, -inf,
    +inf, or with ``(`` before one that is left out), ``@field:[lon lat radius
    unit]`` or a query in parentheses.
    """
    items = re.findall(r'@\w+:\{[^}]*\}|@\w+:\[[^\]]*\]|@\w+:|"[^"]*"|[()|-]|[^\s()|"@{}-]+', query)
    at = 0

    def peek() -> str:
        return items[at] if at < len(items) else ""

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == "|":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def both() -> Node:
        nonlocal at
        parts = [negated()]
        while peek() not in ("", ")", "|"):
            if peek().upper() == "AND":
                at += 1
                continue
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def negated() -> Node:
        nonlocal at
        if peek() == "-" or peek().upper() == "NOT":
            at += 1
            return Node("not", parts=(negated(),))
        return single("")

    def single(prefix: str) -> Node:
        nonlocal at
        item = peek()
        if not item:
            raise ValueError(f"query ends too early: {query!r}")
        at += 1
        if item == "(":
            inside = either()
            if peek() != ")":
                raise ValueError(f"no closing parenthesis: {query!r}")
            at += 1
            return inside
        if m := re.fullmatch(r"@(\w+):\{([^}]*)\}", item):
            return Node("tag", f"{m[1]}:{m[2].strip().lower()}")
        if m := re.fullmatch(r"@(\w+):\[([^\]]*)\]", item):
            parts = m[2].split()
            if len(parts) not in (2, 4):
                raise ValueError(f"not a range or place: {item}")
            return Node("range" if len(parts) == 2 else "place", f"{m[1]}:{' '.join(parts)}")
        if m := re.fullmatch(r"@(\w+):", item):
            return single(f"{m[1]}:")
        if item.startswith('"'):
            words = tuple(Node("term", prefix + w) for w in re.findall(r"\w+", item.lower()))
            return Node("and", parts=words) if len(words) != 1 else words[0]
        if item.endswith("*") and len(item) > 1:
            return Node("prefix", prefix + item[:-1].lower())
        if item in (")", "|"):
            raise ValueError(f"unexpected {item}: {query!r}")
        return Node("term", prefix + item.lower())

    tree = either()
    if at < len(items):
        raise ValueError(f"unexpected {peek()}: {query!r}")
    return tree


def _leaves(node: Node) -> list[Node]:
    return [node] if not node.parts else [x for p in node.parts for x in _leaves(p)]


def _truth(node: Node, leaf: dict[Node, Column]) -> Column:
    if node.kind == "not":
        return ~_truth(node.parts[0], leaf)
    if node.parts:
        out = _truth(node.parts[0], leaf)
        for p in node.parts[1:]:
            out = out & _truth(p, leaf) if node.kind == "and" else out | _truth(p, leaf)
        return out
    return leaf.get(node, F.lit(node.kind == "and"))


def _number(x: str) -> tuple[float, bool]:
    return float(x.removeprefix("(")), x.startswith("(")


def _holds(node: Node) -> Column:
    """Whether a row of numbers or places is in a range or near a place."""
    name, _, rest = node.value.partition(":")
    parts = rest.split()
    if node.kind == "range":
        (low, above), (high, below) = _number(parts[0]), _number(parts[1])
        value = F.col("value")
        return (F.col("field") == name) & (value > low if above else value >= low) & (value < high if below else value <= high)
    lon, lat, metres = float(parts[0]), float(parts[1]), float(parts[2]) * g.UNITS[parts[3].lower()]
    return (F.col("field") == name) & g.near_box(F.col("lon"), F.col("lat"), lon, lat, metres) & (g.distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= metres)


def stemmed(node: Node, known: set[str]) -> Node:
    """The query with each word that no document has replaced by its stem, where that is a term (``known``)."""
    if node.parts:
        return Node(node.kind, node.value, tuple(stemmed(p, known) for p in node.parts))
    if node.kind != "term" or node.value in known:
        return node
    field, colon, word = node.value.rpartition(":")
    cut = f"{field}{colon}{t.stem_of(word)}"
    return Node("term", cut) if cut in known else node


def ask(index: Index, query: str, stem: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Ids of an index's documents for which a query holds; with ``stem`` words without documents are tried by their stem."""
    tree = parse(query)
    if stem:
        words = [x.value for x in _leaves(tree) if x.kind == "term"]
        tried = sorted({*words, *(f"{w.rpartition(':')[0]}{w.rpartition(':')[1]}{t.stem_of(w.rpartition(':')[2])}" for w in words)})
        known = {r["term"] for r in index.postings.where(F.col("term").isin(tried)).select("term").distinct().collect()}
        tree = stemmed(tree, known)
    return matching(index.docs, index.postings, tree, index.tags, id_col, index.numbers, index.places)


def matching(docs: DataFrame, posting: DataFrame, query: str | Node, tags: DataFrame | None = None, id_col: str = "doc_id", numbers: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Ids of the documents for which a query holds.

    Postings of all leaves are read once and aggregated by document; a query
    that holds without any of its leaves (as a bare not) is joined to all
    documents from the left, others never touch the documents.
    """
    tree = parse(query) if isinstance(query, str) else query
    leaves = list(dict.fromkeys(_leaves(tree)))
    words = [x for x in leaves if x.kind in ("term", "prefix")]
    hit = {x: (F.col("term") == x.value if x.kind == "term" else F.col("term").startswith(x.value)) for x in words}
    rows = None
    if words:
        wanted = hit[words[0]]
        for x in words[1:]:
            wanted = wanted | hit[x]
        rows = posting.where(wanted).select("doc_id", *[hit[x].alias(f"_{leaves.index(x)}") if x in hit else F.lit(False).alias(f"_{leaves.index(x)}") for x in leaves])
    marked = [x for x in leaves if x.kind == "tag"]
    if marked:
        if tags is None:
            raise ValueError("the query has tags, but there is no tag table")
        value = F.concat_ws(":", "field", "tag") if "field" in tags.columns else F.col("tag")
        names = {x: x.value if "field" in tags.columns else x.value.partition(":")[2] for x in marked}
        own = tags.where(value.isin(list(names.values()))).select("doc_id", *[(value == names[x]).alias(f"_{i}") if x in names else F.lit(False).alias(f"_{i}") for i, x in enumerate(leaves)])
        rows = own if rows is None else rows.unionByName(own)
    for kind, table in (("range", numbers), ("place", places)):
        held = {x: _holds(x) for x in leaves if x.kind == kind}
        if held:
            if table is None:
                raise ValueError(f"the query has a {kind}, but there is no such table")
            some = F.lit(False)
            for h in held.values():
                some = some | h
            own = table.where(some).select("doc_id", *[held[x].alias(f"_{i}") if x in held else F.lit(False).alias(f"_{i}") for i, x in enumerate(leaves)])
            rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        return docs.limit(0).select(F.col(id_col).alias("doc_id"))
    by_doc = rows.groupBy("doc_id").agg(*[F.max(f"_{i}").alias(f"_{i}") for i in range(len(leaves))])
    if _holds_alone(tree):
        by_doc = docs.select(F.col(id_col).alias("doc_id")).join(by_doc, "doc_id", "left")
    truth = _truth(tree, {x: F.coalesce(F.col(f"_{i}"), F.lit(False)) for i, x in enumerate(leaves)})
    return by_doc.where(truth).select("doc_id")


def _holds_alone(node: Node) -> bool:
    """Whether the query holds for a document with none of its leaves."""
    if node.kind == "not":
        return not _holds_alone(node.parts[0])
    if node.kind == "and":
        return all(map(_holds_alone, node.parts))
    return node.kind == "or" and any(map(_holds_alone, node.parts))


def scored(docs: DataFrame, posting: DataFrame, found: DataFrame, words: list[str], id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``score`` of the found documents: sum over the words of tf * ln((N - df + 0.5) / (df + 0.5) + 1).

    N counts all documents. Words that occur nowhere add nothing.
    """
    words = list(words)
    times = F.create_map(*[F.lit(x) for w in dict.fromkeys(words) for x in (w, words.count(w))]) if words else None
    if times is None:
        return found.withColumn("score", F.lit(0.0))
    own = posting.where(F.col("term").isin(words))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("_n"))
    idf = df.join(F.broadcast(n)).select("term", (F.log((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * times[F.col("term")]).alias("_idf"))
    sums = own.join(F.broadcast(idf), "term").groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("_idf")).alias("_s"))
    return found.join(sums, "doc_id", "left").select("doc_id", F.coalesce("_s", F.lit(0.0)).alias("score"))


def query_words(query: str, stop_words: bool = True) -> list[str]:
    """Words of the raw query text that take part in the score."""
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    return [w for w in words if not stop_words or w not in t.STOP_WORDS]


def search(docs: DataFrame, posting: DataFrame, query: str, tags: DataFrame | None = None, offset: int = 0, limit: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Matching documents with their score; with a limit above 0 a top-k by score and id."""
    out = scored(docs, posting, matching(docs, posting, query, tags, id_col), query_words(query), id_col)
    return out if limit <= 0 else out.orderBy(F.col("score").desc(), "doc_id").offset(offset).limit(limit)


def search_index(index: Index, query: str, sort_by: str | None = None, descending: bool = False, returned: list[str] | None = None, offset: int = 0, limit: int = 0, stem: bool = False, id_col: str = "doc_id") -> DataFrame:
    """Matching documents of an index with their score and the fields asked for.

    Ordered by a field (``sort_by``; nulls last, ties by id), else by score,
    where a limit is given.
    """
    out = scored(index.docs, index.postings, ask(index, query, stem, id_col), query_words(re.sub(r"@\w+:(\{[^}]*\}|\[[^\]]*\])?", " ", query)), id_col)
    fields = list(dict.fromkeys([*(returned or []), *([sort_by] if sort_by else [])]))
    if fields:
        out = out.join(index.docs.select(F.col(id_col).alias("doc_id"), *[f for f in fields if f != "doc_id"]), "doc_id")
    key = F.col(sort_by) if sort_by else F.col("score")
    if limit > 0:
        out = out.orderBy(key.desc_nulls_last() if descending or not sort_by else key.asc_nulls_last(), "doc_id").offset(offset).limit(limit)
    elif sort_by:
        out = out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "doc_id")
    return out.select("doc_id", "score", *[f for f in returned or [] if f != "doc_id"])


_REDUCE = {"count": lambda c: F.count("*"), "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "tolist": lambda c: F.array_sort(F.collect_list(c))}


def aggregate(docs: DataFrame, found: DataFrame | None, by: list[str], reducers: list[tuple[str, str, str]], sort: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """Groups of the found documents (all of them without ``found``) with reducers (function, field, name)."""
    rows = docs if found is None else docs.join(found.select(F.col("doc_id").alias(id_col)), id_col, "left_semi")
    out = rows.groupBy(*by).agg(*[_REDUCE[f.lower()](field).alias(name) for f, field, name in reducers])
    if sort is not None:
        out = out.orderBy(F.col(sort).desc() if descending else F.col(sort), *by)
    return out if limit is None else out.offset(offset).limit(limit)


def suggest(posting: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Terms with a prefix, in order."""
    return posting.where(F.col("term").startswith(prefix)).select("term").distinct().orderBy("term").limit(limit)


def sug_add(table: DataFrame, rows: DataFrame, increase: bool = False) -> DataFrame:
    """Suggestions (key, term, score) with more rows (key, term, score), that replace those of the term or raise its score (INCR)."""
    if increase:
        return table.unionByName(rows).groupBy("key", "term").agg(F.sum("score").alias("score"))
    new = rows.groupBy("key", "term").agg(F.max("score").alias("score"))
    return table.join(new, ["key", "term"], "left_anti").unionByName(new)


def sug_get(table: DataFrame, key: str, prefix: str, limit: int = 5) -> DataFrame:
    """The best suggestions with a prefix, upper and lower case alike, by score and term."""
    return table.where((F.col("key") == key) & F.lower("term").startswith(prefix.lower())).select("term", "score").orderBy(F.col("score").desc(), "term").limit(limit)


def spell_check(posting: DataFrame, words: list[str], distance: int = 1, limit: int = 5, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """For words that are no terms, up to so many terms within an edit distance, by distance, frequency and term.

    Terms of too different a length are left out before the distance is made.
    The terms of ``include`` (term) count as terms too, with no document; those
    of ``exclude`` are not proposed (TERMS INCLUDE and EXCLUDE). In place of
    postings ``term_counts`` will do.
    """
    terms = posting.select("term", "df") if "df" in posting.columns else posting.groupBy("term").agg(F.count("*").alias("df"))
    if include is not None:
        terms = terms.unionByName(include.select("term", F.lit(0).cast("long").alias("df"))).groupBy("term").agg(F.max("df").alias("df"))
    if exclude is not None:
        terms = terms.join(exclude.select("term").distinct(), "term", "left_anti")
    asked = posting.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w.lower()) for w in dict.fromkeys(words)])).alias("word"))
    unknown = asked.join(terms.where(F.col("term").isin([w.lower() for w in words])), F.col("word") == F.col("term"), "left_anti")
    near = terms.join(F.broadcast(unknown), F.abs(F.length("word") - F.length("term")) <= distance).withColumn("distance", F.levenshtein("word", "term", distance)).where(F.col("distance") >= 0)
    w = Window.partitionBy("word").orderBy("distance", F.col("df").desc(), "term")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("word", "rank", "term", "distance")


def dict_add(table: DataFrame, name: str, terms: list[str]) -> DataFrame:
    """The dictionaries (dict, term) with more terms."""
    rows = table.sparkSession.range(1).select(F.lit(name).alias("dict"), F.explode(F.array(*[F.lit(x) for x in terms])).alias("term"))
    return table.select("dict", "term").union(rows).distinct()


def dict_del(table: DataFrame, name: str, terms: list[str]) -> DataFrame:
    return table.where(~((F.col("dict") == name) & F.col("term").isin(terms)))


def dict_dump(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("dict") == name).select("term")


def syn_update(table: DataFrame, group: str, terms: list[str]) -> DataFrame:
    """The synonyms (grp, term) with one group replaced."""
    rows = table.sparkSession.range(1).select(F.lit(group).alias("grp"), F.explode(F.array(*[F.lit(x.lower()) for x in terms])).alias("term"))
    return table.where(F.col("grp") != group).select("grp", "term").union(rows).distinct()


def syn_dump(table: DataFrame) -> DataFrame:
    """``term`` and ``groups``, the groups it is in, in order."""
    return table.groupBy("term").agg(F.array_sort(F.collect_set("grp")).alias("groups"))


def syn_expand(synonyms: DataFrame, words: list[str]) -> DataFrame:
    """The words and all terms of groups they are in."""
    spark = synonyms.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in words])).alias("term"))
    groups = synonyms.join(F.broadcast(asked), "term", "left_semi").select("grp").distinct()
    return synonyms.join(groups, "grp", "left_semi").select("term").union(asked).distinct()


def info(docs: DataFrame, posting: DataFrame) -> DataFrame:
    """Numbers of documents, terms and postings, from the postings or from ``term_counts``."""
    counts = posting if "df" in posting.columns else posting.groupBy("term").agg(F.count("*").alias("df"))
    p = counts.agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0).cast("long")).alias("records"))
    return docs.agg(F.count("*").alias("docs")).join(p)
