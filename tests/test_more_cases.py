"""Order, edges and slow versions: sort, log text, longest common subsequence, sketches, grid, queues, stored folders."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import text as tx
from keyloom.operators import geo, keyspace, placement, search, sketches, strings, vectors
from keyloom.sources import log, tables


def test_sort_keeps_its_order_with_results(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.random()) for i in range(3000)]
    e = spark.createDataFrame(rows, "value long, weight double").repartition(7)
    got = keyspace.sort(e.select("value"), by=e, get=e.select("value", F.concat(F.lit("r"), "value").alias("result")), descending=True)
    want = [i for i, _ in sorted(rows, key=lambda r: -r[1])]
    assert [r["value"] for r in got.collect()] == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = keyspace.sort(e.select("value"), by=e, get=e.select("value", F.lit("r").alias("result")), offset=5, limit=20)
        assert [r["value"] for r in got.collect()] == want[::-1][5:25]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_log_text_with_any_arguments(spark, tmp_path):
    args = [["set", "a", "x\r\n$3\r\ny"], ["set", "é", ""], ["*2\r\n", "\r\n", "$"], ["ping"]]
    text = log.encode_resp(spark.createDataFrame([(i, a) for i, a in enumerate(args)], "seq long, args array<string>")).orderBy("seq").collect()
    data = "".join(r["resp"] for r in text).encode()
    assert [*log.decode_resp(data)] == args
    for cut in range(1, len(data)):
        assert args[: len([*log.decode_resp(data[:cut])])] == [*log.decode_resp(data[:cut])]
    with pytest.raises(ValueError, match="length mark"):
        [*log.decode_resp(b"+OK\r\n")]
    (tmp_path / "a.log").write_bytes(data * 3000)
    (tmp_path / "b.log").write_bytes(b"")
    got = log.read_resp(spark, str(tmp_path)).orderBy("n").collect()
    assert [list(r["args"]) for r in got] == args * 3000 and [r["n"] for r in got] == list(range(12_000))


def test_longest_common_subsequence_against_a_slow_version(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("abc", k=rnd.randrange(12))), "".join(rnd.choices("abc", k=rnd.randrange(12)))) for _ in range(120)] + [(None, "a"), ("é", "é")]

    def size(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for r in strings.lcs(spark.createDataFrame(pairs, "a string, b string")).collect():
        x, y = (r["a"] or "").encode(), (r["b"] or "").encode()
        assert r["length"] == size(x, y)
        if all(c < 128 for c in x + y):
            for whole in (x, y):
                it = iter(whole)
                assert all(c in it for c in r["lcs"].encode())


def test_digest_is_small_and_near(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=20_000)
    t = spark.createDataFrame([("k", float(v)) for v in x] + [("one", 3.0), ("none", None), ("none", float("nan"))], "key string, value double").repartition(6)
    d = sketches.digest(t)
    sizes = {r["key"]: r["n"] for r in d.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert sizes["k"] <= 200 and sizes["one"] == 1 and "none" not in sizes
    got = {r["key"]: r for r in sketches.digest_quantile(d, [0.0, 0.5, 0.99, 1.0]).collect()}
    for q, v in zip([0.5, 0.99], [got["k"]["q1"], got["k"]["q2"]], strict=True):
        assert abs((x <= v).mean() - q) < 0.01
    assert (got["k"]["q0"], got["k"]["q3"]) == (x.min(), x.max()) and got["one"]["q1"] == 3.0


def test_cuckoo_filter_forgets(spark):
    t = spark.createDataFrame([("k", i, 1) for i in range(50)] + [("k", 7, -1), ("k", 8, 1)], "key string, item long, delta int")
    f = sketches.cf_add(t, sketches.cf_size(100))
    got = {r["item"]: r["n"] for r in sketches.cf_count(f, spark.range(60).select(F.lit("k").alias("key"), F.col("id").alias("item")), sketches.cf_size(100)).collect()}
    assert (got[7], got[8], got[9], got[55]) == (0, 2, 1, 0)


@pytest.mark.parametrize("metres", [10.0, 50_000.0, 900_000.0, 6_000_000.0])
def test_grid_join_finds_all_pairs(spark, metres):
    rnd = random.Random(int(metres))
    points = [("k", str(i), rnd.uniform(-180, 180), rnd.choice([rnd.uniform(-90, 90), 89.99, -89.99, rnd.uniform(84, 90)])) for i in range(150)]
    points += [("k", f"n{i}", x + rnd.uniform(-0.00008, 0.00008), max(-90.0, min(90.0, y + rnd.uniform(-0.00008, 0.00008)))) for i, (_, _, x, y) in enumerate(points[:60])]
    p = spark.createDataFrame(points, "key string, member string, lon double, lat double")
    c = p.where("try_cast(member as int) < 80").select(F.col("member").alias("id"), "lon", "lat")
    got = {(r["id"], r["member"]) for r in geo.near(p, c, metres).collect()}
    every = c.withColumnRenamed("lon", "x").withColumnRenamed("lat", "y").crossJoin(p)
    from keyloom.functions import geo as g

    want = {(r["id"], r["member"]) for r in every.where(g.distance(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")) <= metres).collect()}
    assert got == want and len(want) >= 80


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 8))
    v[5] = 0
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 8), (999, None), (998, [1.0])], "id long, embedding array<double>")
    for metric in ("cosine", "dot", "euclidean"):
        whole = sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.vsquery(t, [3, 5, 8], 4, metric).collect())
        for q in (3, 8):
            with np.errstate(invalid="ignore", divide="ignore"):
                s = {"cosine": np.nan_to_num(v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))), "dot": v @ v[q], "euclidean": -np.linalg.norm(v - v[q], axis=1)}[metric]
            assert [i for k, _, i in whole if k == q] == [j for j in np.argsort(-s, kind="stable").tolist() if j != q][:4]
        monkeypatch.setattr(vectors, "QUERY_BYTES", 64)
        assert sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.vsquery(t, [3, 5, 8], 4, metric).collect()) == whole
        monkeypatch.undo()


def test_stems_of_planned_and_of_stored_words_agree(spark):
    words = ["Licenses", "studies", "tried", "dying", "es", "is", "as", "nation", "happily", "x", "", "ües"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", tx.stem(F.col("w")).alias("s")).collect()
    assert all(r["s"] == tx.stem_of(r["w"]) for r in got)


def test_index_of_two_text_fields(spark):
    docs = spark.createDataFrame([(1, "red apple", "green"), (2, "green tree", None), (3, None, "red red")], "doc_id long, title string, body string")
    i = search.build(docs, {"title": "text", "body": "text"})
    ids = lambda q: sorted(r["doc_id"] for r in search.ask(i, q).collect())
    assert ids("red") == [1, 3] and ids("@title:red") == [1] and ids("@body:red") == [3] and ids("green -@title:green") == [1]
    assert {(r["term"], r["doc_id"]): r["tf"] for r in i.postings.collect()}["red", 3] == 2
    with pytest.raises(ValueError, match="range"):
        search.parse("@n:[1]")


def test_restored_and_busy_keys(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string").withColumn("expire_at", F.lit(None).cast("timestamp"))
    blobs = keyspace.dump(t, F.lit("2024-01-01").cast("timestamp"))
    assert keyspace.restore(blobs, table=t.where("key = 'a'")).count() == 2


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Session:
        conf: dict = {}

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared(Session(), "x")


def test_writes_with_bad_options(spark):
    from keyloom.streaming import live

    with pytest.raises(ValueError, match="take"):
        live.queue(spark.range(1), "middle")


def test_ring_against_a_slow_version(spark):
    import zlib

    points = placement.ring(["a", "b", "", "c"], 40)
    keys = [f"key{i}" for i in range(300)] + ["{tag}x", "y{tag}", "{}z", "", "é"]

    def pick(key):
        start, end = key.find("{"), key.find("}")
        if 0 <= start < end - 1:
            key = key[start + 1 : end]
        return next((n for p, n in points if p >= zlib.crc32(key.encode())), points[0][1])

    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", placement.node_of(F.col("k"), points).alias("n")).collect()
    assert all(r["n"] == pick(r["k"]) for r in got) and len({r["n"] for r in got}) == 3


def test_rebalanced_slots_are_even(spark):
    t = spark.createDataFrame([(i, "a" if i < 50 else "gone" if i < 60 else "b") for i in range(101)], "slot long, node string")
    got = placement.rebalance(t, ["a", "b", "c"]).collect()
    assert len({r["slot"] for r in got}) == 101
    assert sorted(sum(r["node"] == x for r in got) for x in "abc") == [33, 34, 34] and sum(r["node"] == r["old"] for r in got) == 34 + 34
