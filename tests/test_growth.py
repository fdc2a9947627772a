"""Work that grows no faster than its input: what is joined, shuffled, planned and held in memory."""

from __future__ import annotations

import random
import sys
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.operators import channels, lists, placement, search, strings, vectors
from keyloom.plans.queries import QUERIES
from keyloom.sources import tables
from keyloom.streaming import live


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_deliveries_are_counted_without_a_row_for_each(spark, data):
    messages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("none", 5)], "channel string, id long")
    subs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (None, "b"), (4, None)], "client long, channel string")
    for by in ("client", "channel"):
        want = {(r[by], r["count"]) for r in channels.delivered(messages, subs).groupBy(by).count().collect()}
        assert {(r[by], r["n"]) for r in channels.delivered_counts(messages, subs, by).collect()} == want
    # Every side of the join is an aggregate: one row for each channel, one for each subscription.
    lines = plan(QUERIES["pubsub_delivered"](spark, data)).split("\n")
    joins = [i for i, x in enumerate(lines) if "Join Inner" in x]
    depth = len(lines[joins[0]]) - len(lines[joins[0]].lstrip(" :+-")) + 3
    sides = [x for x in lines[joins[0] + 1 :] if len(x) - len(x.lstrip(" :+-")) == depth]
    assert len(joins) == 1 and len(sides) == 2 and all(x.lstrip(" :+-").startswith("Aggregate") for x in sides)


def test_an_index_asked_for_places_reads_no_text(spark, data, monkeypatch):
    def refuse(*_):
        raise AssertionError("nothing is to be written")

    monkeypatch.setattr(tables, "shared", refuse)
    got = QUERIES["ft_geo"](spark, data)
    schemas = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x]
    assert schemas and not any("text:" in x for x in schemas)


def test_terms_are_filtered_before_the_shuffle_of_an_index(spark, data):
    docs = spark.createDataFrame([(1, "red red apple"), (2, "Apple"), (2, "tree apple"), (3, None)], "doc_id long, body string")
    index = search.build(docs, {"body": "text"})
    rows = {(r["term"], r["doc_id"]): (r["tf"], r["positions"]) for r in index.postings.collect()}
    assert rows == {(p + w, i): v for (w, i), v in {("red", 1): (2, [0, 1]), ("apple", 1): (1, [2]), ("apple", 2): (2, [0, 1]), ("tree", 2): (1, [0])}.items() for p in ("", "body:")}
    for name in ("ft_field_term", "ft_numeric", "ft_del"):
        lines = plan(QUERIES[name](spark, data)).split("\n")
        at = [i for i, x in enumerate(lines) if "Filter" in x and "license" in x]
        own = [x for x in lines[at[-1] + 1 :] if "Aggregate" in x or "Filter" in x and "license" in x]
        under = lines[at[0]]
        assert at and not any("Aggregate" in x and len(x) - len(x.lstrip(" :+-")) > len(under) - len(under.lstrip(" :+-")) for x in own)


def test_terms_are_counted_without_postings(spark, data, monkeypatch):
    docs = spark.createDataFrame([(1, "red red apple the"), (2, "Apple tree"), (2, "tree tree apple"), (None, "red"), (None, "red licences"), (3, None), (4, "a 9")], "id long, body string")
    for rows in (docs, docs.where("id <> 2")):
        for stem in (False, True):
            want = {tuple(r) for r in search.term_stats(search.postings(rows, "body", stem=stem, id_col="id")).collect()}
            assert {tuple(r) for r in search.term_counts(rows, "body", stem=stem, id_col="id").collect()} == want
            assert {tuple(r) for r in search.term_counts(rows, "body", stem=stem, id_col="id", total=False).collect()} == {(w, df) for w, df, _ in want}
    own, made = search.term_counts(docs, "body", id_col="id"), search.postings(docs, "body", id_col="id")
    assert search.info(docs, own).collect() == search.info(docs, made).collect()
    assert sorted(search.spell_check(own, ["appl", "tre"]).collect()) == sorted(search.spell_check(made, ["appl", "tre"]).collect())
    assert search.info(docs.limit(0), search.term_counts(docs.limit(0), "body", id_col="id")).first().asDict() == {"docs": 0, "terms": 0, "records": 0}

    def refuse(*_):
        raise AssertionError("nothing is to be written")

    monkeypatch.setattr(tables, "shared", refuse)
    for name in ("ft_terms", "ft_info", "ft_spellcheck"):
        lines = [x for x in plan(QUERIES[name](spark, data)).split("\n") if "Aggregate [" in x]
        assert lines and not any("doc_id" in x for x in lines)
    assert any("Filter" in x and "license" in x for x in plan(QUERIES["ft_search_and"](spark, data)).split("Aggregate")[-1].split("\n"))


def brute(rows, take):
    """What each pop gets, one event after another."""
    items, waiting, out = [], [], []
    order = {"first": lambda x: x[2], "last": lambda x: -x[2], "min": lambda x: x[:2]}.get(take)
    for at, (_, kind, value, score) in enumerate(sorted(rows)):
        if kind == "push":
            items.append((score, value, at))
        else:
            waiting.append(value)
        if items and waiting:
            best = min(items, key=order) if order else max(items, key=lambda x: x[:2])
            items.remove(best)
            out.append((waiting.pop(0), best[1]))
    return sorted(out)


@pytest.mark.parametrize("take", ["first", "last", "min", "max"])
def test_waiting_pops_against_a_slow_version_over_batches(spark, tmp_path, take):
    rnd = random.Random(take)
    rows = [(k, i, rnd.choices(["push", "pop"], [3, 2 + (i // 60) % 3])[0], f"{k}{i % 50:02}é", float(rnd.randrange(4))) for k in "ab" for i in range(300)]
    names = [f"{k}{i}" for k, i, *_ in rows]
    rows = [(k, i, kind, n if kind == "pop" else v, x) for (k, i, kind, v, x), n in zip(rows, names, strict=True)]
    for part in range(3):
        some = [r for r in rows if part * 100 <= r[1] < part * 100 + 100]
        rnd.shuffle(some)
        spark.createDataFrame(some, "key string, n long, kind string, value string, score double").coalesce(1).write.parquet(str(tmp_path / f"q.parquet{part}"))
    (tmp_path / "q.parquet0").rename(tmp_path / "q.parquet")
    got = live.run_available(live.queue(live.read(spark, str(tmp_path / "q.parquet")), take)).collect()
    for k in "ab":
        assert sorted((r["who"], r["value"]) for r in got if r["key"] == k) == brute([r[1:] for r in rows if r[0] == k], take)


class State:
    exists, get = False, None

    def update(self, x):
        self.exists, self.get = True, x


def step_of(monkeypatch, df, make):
    """The function of a live query's keys, to be run here."""
    found = []
    monkeypatch.setattr(type(df.groupBy("key")), "applyInPandasWithState", lambda self, f, *a: found.append(f) or df)
    make(df)
    monkeypatch.undo()
    return found[0]


@pytest.mark.parametrize("take", ["first", "last", "min", "max"])
def test_a_queue_holds_no_object_for_each_event(spark, monkeypatch, take):
    n, size = 60_000, 5_000
    df = spark.createDataFrame([], "key string, n long, kind string, value string, score double")
    step, state = step_of(monkeypatch, df, lambda x: live.queue(x, take)), State()
    batches = (pd.DataFrame({"n": range(at, at + size), "kind": ["push" if at < n * 2 // 3 else "pop"] * size, "value": [f"v{i}" for i in range(at, at + size)], "score": np.arange(size) % 7.0}) for at in range(0, n, size))
    tracemalloc.start()
    served = sum(len(p) for p in step(("k",), batches, state))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert served == n // 3 and peak < 100 * n


def test_consumer_groups_hold_no_object_for_each_entry(spark, monkeypatch):
    n, size = 60_000, 5_000
    df = spark.createDataFrame([], "key string, ms long, seq long")
    step, state = step_of(monkeypatch, df, lambda x: live.consumer_groups(x, 3)), State()
    tracemalloc.start()
    (out,) = step(("k",), (pd.DataFrame({"ms": np.arange(at, at + size) // 2, "seq": np.arange(at, at + size) % 2}) for at in range(0, n, size)), state)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * n and out["given"].tolist() == [n // 3] * 3 and state.get == (n // 2 - 1, 1, n)
    # Nothing at or before the cursor, an id once, turns go on.
    (out,) = step(("k",), iter([pd.DataFrame({"ms": [n, 5, n, n + 1], "seq": [1, 0, 1, 0]})]), state)
    assert dict(zip(out["consumer"], out["given"], strict=True)) == {0: 1, 1: 1} and state.get == (n + 1, 0, n + 2)
    assert list(step(("k",), iter([pd.DataFrame({"ms": [5], "seq": [0]})]), state)) == []


def test_an_insert_sorts_a_list_once(spark):
    rnd = random.Random(4)
    have = {k: [rnd.choice(["a", "b", "c", None]) for _ in range(rnd.randrange(12))] for k in range(40)}
    t = spark.createDataFrame([(k, 3 * i - 7, v) for k, vs in have.items() for i, v in enumerate(vs)], "key long, pos long, value string")
    for after in (False, True):
        got = lists.linsert(t, "b", "X", after)
        want = set()
        for k, vs in have.items():
            at = vs.index("b") + after if "b" in vs else None
            want |= {(k, i, v) for i, v in enumerate(vs if at is None else [*vs[:at], "X", *vs[at:]])}
        rows = [tuple(r) for r in got.collect()]
        assert set(rows) == want and len(rows) == len(want)
        assert "Join" not in plan(got) and "Union" not in plan(got)
    assert sorted(r["value"] for r in lists.linsert(t.where("key = 1"), None, "X").collect() if r["value"]) == sorted(v for v in have[1] if v)


def test_vectors_are_scored_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, size=(300, 4)).astype(float)
    v[7] = 0
    v[11, 2] = np.nan
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(vectors, "TILE", 16)
    for metric in ("cosine", "dot", "euclidean"):
        got = vectors.vsquery(t, t.where("id % 5 = 0").select("id"), 6, metric).collect()
        for q in range(0, 300, 5):
            with np.errstate(invalid="ignore", divide="ignore"):
                s = {"cosine": v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])), "dot": v @ v[q], "euclidean": -np.linalg.norm(v - v[q], axis=1)}[metric]
            s = np.where((np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]) == 0) & (metric == "cosine"), 0.0, s)
            s[[q, 11]] = -np.inf
            want = sorted((-round(x, 9), i) for i, x in enumerate(s) if x > -np.inf)[:6] if q != 11 else []
            assert sorted((-round(r["score"], 9), r["id"]) for r in got if r["query_id"] == q)[:6] == want or metric != "dot" and np.allclose(sorted(-r["score"] for r in got if r["query_id"] == q), [x for x, _ in want], atol=1e-7)


def test_many_queries_hold_one_tile_of_scores(spark, monkeypatch):
    found = []
    df = spark.createDataFrame([], "id long, embedding array<double>")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a: found.append(f) or df)
    n, m = 4096, 2048
    x = np.random.default_rng(6).normal(size=(n, 8))
    rows = pa.table({"id": pa.array(range(n)), "embedding": pa.array(x.tolist())})
    vectors._best(df, rows, 8, 3, "dot")
    monkeypatch.undo()
    batch = rows.slice(0, m).to_batches()[0]
    tracemalloc.start()
    (out,) = found[0](iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = x @ x[:m].T
    s[np.arange(m), np.arange(m)] = -np.inf
    assert peak < 64 << 20 and out.column(1).to_pylist() == np.argsort(-s, axis=1, kind="stable")[:, :3].ravel().tolist()


def test_moved_slots_are_no_part_of_the_plan(spark):
    n = 5000
    t = spark.range(n).select(F.col("id").alias("slot"), F.when(F.col("id") % 4 == 3, None).otherwise(F.concat(F.lit("n"), F.col("id") % 3)).alias("node"))
    out = placement.rebalance(t, ["n0", "new", "n1", "last"])
    assert len(plan(out)) < 20_000
    rows = out.collect()
    held = {x: sorted(i for i in range(n) if i % 4 != 3 and f"n{i % 3}" == x) for x in ("n0", "n1")}
    kept = {i: x for x, ids in held.items() for i in ids[: n // 4]}
    free = sorted(set(range(n)) - set(kept))
    # Free slots go in order to the nodes with room, in the order of the nodes.
    want = kept | dict(zip(free, ["new"] * (n // 4) + ["last"] * (n // 4), strict=True))
    assert {r["slot"]: r["node"] for r in rows} == want and len(rows) == n
    assert all(r["old"] == (None if r["slot"] % 4 == 3 else f"n{r['slot'] % 3}") for r in rows)


def test_tables_of_many_pairs_are_made_together(spark, monkeypatch):
    def slow(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
        i, j, out = len(x), len(y), ""
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j, out = i - 1, j - 1, x[i - 1] + out
            elif t[i - 1][j] > t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    found, rnd = [], random.Random(7)
    df = spark.createDataFrame([], "a string, b string")
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, *a: found.append(f) or df)
    strings.lcs(df)
    monkeypatch.undo()
    pairs = pd.DataFrame([("".join(rnd.choices("abc ", k=rnd.randrange(30))), "".join(rnd.choices("abc ", k=rnd.randrange(30)))) for _ in range(1000)] + [(None, "a"), ("", ""), ("ab", None)], columns=["a", "b"])
    calls = [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + ("call" in event)))
    try:
        (out,) = found[0](iter([pairs]))
    finally:
        sys.setprofile(None)
    want = [slow(x or "", y or "") for x, y in zip(pairs["a"], pairs["b"], strict=True)]
    assert out["lcs"].tolist() == want and out["length"].tolist() == [len(w) for w in want] and calls[0] < 25 * len(pairs)
    monkeypatch.setattr(strings, "TABLE", 500)
    assert next(iter(found[0](iter([pairs]))))["lcs"].tolist() == want
