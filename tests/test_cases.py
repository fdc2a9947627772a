"""Literal cases and edge cases of the keyed operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keyloom.functions import bits
from keyloom.functions import text as tx
from keyloom.operators import geo, hashes, jsondoc, keyspace, lists, search, sets, sketches, streams, strings, timeseries, udfs, vectors, zsets
from keyloom.operators.access import allowed, refused
from keyloom.sources import log, tables
from keyloom.streaming import live


def col(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("x", "c", 3.0), ("y", "b", 1.0), ("y", "c", 2.0), ("y", "d", 3.0)], "key string, member string, score double")


@pytest.fixture(scope="module")
def hundred(spark):
    return spark.range(100).select(F.lit("k").alias("key"), F.format_string("m%03d", "id").alias("member"), F.col("id").cast("double").alias("score"))


def test_geo(spark):
    t = spark.createDataFrame([("k", "p", 13.361389, 38.115556), ("k", "q", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    assert ("p", "sqc8b49rnys00") in col(geo.geohash(t), "member", "hash")
    assert 166274 < geo.geodist(t, "p", "q").first()["distance"] < 166275
    assert geo.search(t, 15.0, 37.0, radius=200, unit="km").count() == 2
    assert geo.search(t, 15.0, 37.0, radius=200, unit="km", without="p").count() == 1
    lon, lat = col(geo.geopos(t.where("member = 'p'")), "lon", "lat")[0]
    assert abs(lon - 13.361389) < 1e-6 and abs(lat - 38.115556) < 1e-6
    assert geo.geoadd(t.withColumn("lon", F.lit(181.0))).count() == 0


def test_scored_sets(two, hundred):
    union = col(zsets.zunion(two, ["x", "y"]).orderBy("score", "member"), "member", "score")
    assert union == [("a", 1.0), ("b", 3.0), ("d", 3.0), ("c", 5.0)]
    weighed = dict(col(zsets.zunion(two, ["x", "y"], [2.0, 3.0]), "member", "score"))
    assert (weighed["a"], weighed["b"]) == (2.0, 7.0)
    assert col(zsets.zdiff(two, ["x", "y"]), "member") == [("a",)]
    scores = [r[0] for r in col(zsets.zrangebyscore(hundred, "20", "30"), "score")]
    assert sorted(scores) == list(range(20, 31))
    assert sorted(r[0] for r in col(zsets.zrangebyscore(hundred, "(20", "(30"), "score")) == list(range(21, 30))
    assert sorted(r[0] for r in col(zsets.zrangebyscore(hundred, "20", "40", offset=5, limit=5), "score")) == list(range(25, 30))
    assert sorted(r[0] for r in col(zsets.zrange(hundred, -3, -1), "score")) == [97, 98, 99]
    assert zsets.zrange(hundred, 5, 2).count() == 0
    assert [r[0] for r in col(zsets.zpop(hundred, 1, largest=True)[0], "score")] == [99]


def test_ties_go_by_member(spark):
    t = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 1.0), ("k", "c", 2.0)], "key string, member string, score double")
    popped, left = zsets.zpop(t, 2)
    assert sorted(col(popped, "member")) == [("a",), ("b",)] and col(left, "member") == [("c",)]


def test_lex_range(spark):
    t = spark.createDataFrame([("k", m, 0.0) for m in "abcde"], "key string, member string, score double")
    assert sorted(col(zsets.zrangebylex(t, "(aa", "(ee"), "member")) == [("b",), ("c",), ("d",), ("e",)]
    with pytest.raises(ValueError):
        zsets.lex_between("a", "b")


def test_sets(spark):
    rows = [(str(k), i + 10 * k) for k in range(4) for i in range(100)]
    t = spark.createDataFrame(rows, "key string, member long")
    assert sets.sinter(t, ["0", "1", "2", "3"]).count() == 70
    assert sets.sinter(t, ["0", "none"]).count() == 0
    assert sets.sunion(t, ["0", "3"]).count() == 130
    assert sets.sdiff(t, ["0", "1"]).count() == 10
    assert sets.sintercard(t, ["0", "1"], 5).first()["n"] == 5


def test_buckets(spark):
    t = spark.createDataFrame([("k", 119_999, 2.5)], "key string, ts long, value double")
    assert col(timeseries.ts_range(t, aggregation="std.s", width=60_000), "ts", "value") == [(60_000, 0.0)]
    assert col(timeseries.ts_range(t, aggregation="var.s", width=60_000), "value") == [(0.0,)]
    with pytest.raises(ValueError):
        timeseries.bucket(0)
    twice = spark.createDataFrame([("k", 1, 1.0, 1), ("k", 1, 2.0, 2)], "key string, ts long, value double, seq long")
    assert col(timeseries.latest(twice), "value") == [(2.0,)]


def test_tokens_and_stems(spark):
    row = spark.range(1).select(tx.tokens(F.lit("Hello, wörld-9")).alias("t"), tx.stem(F.lit("boxes")).alias("a"), tx.stem(F.lit("cities")).alias("b"), tx.stem(F.lit("is")).alias("c"), tx.without_stop_words(F.array(F.lit("the"), F.lit("cat"), F.lit("cat"))).alias("w")).first()
    assert list(row["t"]) == ["hello", "wörld", "9"] and (row["a"], row["b"], row["c"]) == ("boxe", "city", "is") and list(row["w"]) == ["cat", "cat"]


@pytest.mark.parametrize(("pattern", "good", "bad"), [("a*c", ["abc", "ac"], ["abd"]), ("a?c", ["abc"], ["ac"]), ("[ab]x", ["ax", "bx"], ["cx"]), ("[^a]x", ["bx"], ["ax"]), ("a\\*", ["a*"], ["ab"]), ("a.c", ["a.c"], ["abc"]), ("", [""], ["a"])])
def test_globs(spark, pattern, good, bad):
    t = spark.createDataFrame([(x,) for x in good + bad], "name string")
    assert {r["name"] for r in t.where(tx.matches(F.col("name"), pattern)).collect()} == set(good)


def test_glob_must_not_end_with_an_escape():
    with pytest.raises(ValueError):
        tx.glob_to_regex("a\\")


def test_bits(spark):
    t = spark.createDataFrame([("k", bytearray(b"\x05\x80")), ("e", bytearray(b""))], "key string, value binary")
    row = t.where("key = 'k'").select(*[bits.get_bit(F.col("value"), i).alias(f"b{i}") for i in (0, 1, 2, 15, 99)]).first()
    assert tuple(row) == (1, 0, 1, 1, 0)
    assert dict(col(strings.bitcount(t), "key", "n")) == {"k": 3, "e": 0}
    assert dict(col(strings.bitpos(t, 1), "key", "pos")) == {"k": 0, "e": -1}
    assert dict(col(strings.bitpos(t, 0), "key", "pos")) == {"k": 1, "e": -1}
    grown = strings.setbit(t, 17, 1).where("key = 'k'").first()
    assert grown["old"] == 0 and bytes(grown["value"]) == b"\x05\x80\x02"


def test_strings(spark):
    t = spark.createDataFrame([("k", "hello")], "key string, value string")
    assert col(strings.getrange(t, 1, -2), "part") == [("ell",)]
    assert col(strings.getrange(t, 9, 10), "part") == [(None,)]
    assert bytes(strings.setrange(t, 7, "x").first()["value"]) == b"hello\0\0x"
    with pytest.raises(ValueError):
        strings.setrange(t, -1, "x")
    pairs = spark.createDataFrame([("ohmytext", "mynewtext"), (None, "a")], "a string, b string")
    assert sorted(col(strings.lcs(pairs), "length")) == [(0,), (6,)]
    assert sorted(col(strings.lcs_matches("abcx", "zabc", 3, spark), "start1", "start2", "size")) == [(0, 1, 3)]
    assert strings.msetnx(t.select("key", "value"), spark.createDataFrame([("k", "1"), ("n", "2")], "key string, value string")).count() == 1
    assert strings.msetnx(t.select("key", "value"), spark.createDataFrame([("m", "1"), ("n", "2")], "key string, value string")).count() == 3


def test_lists(spark):
    t = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcab")], "key string, pos long, value string")
    assert "".join(r["value"] for r in lists.lrem(t, 1, "a").orderBy("pos").collect()) == "bcab"
    assert "".join(r["value"] for r in lists.lrem(t, -1, "a").orderBy("pos").collect()) == "abcb"
    assert "".join(r["value"] for r in lists.lrem(t, 0, "a").orderBy("pos").collect()) == "bcb"
    assert "".join(r["value"] for r in lists.linsert(t, "b", "X", after=True).orderBy("i").collect()) == "abXcab"
    assert "".join(r["value"] for r in lists.lrange(t, -100, 1).orderBy("i").collect()) == "ab"
    assert lists.lrange(t, 5, 9).count() == 0 and lists.lrange(t, 0, -9).count() == 0
    moved = lists.rpoplpush(t, "k", "n")
    assert col(moved.where("key = 'n'"), "value") == [("b",)] and moved.count() == 5
    assert "".join(r["value"] for r in lists.rpoplpush(t, "k", "k").orderBy("pos").collect()) == "babca"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "key string, member string, score double")
    assert zsets.ranked(empty).count() == 0 and zsets.zunion(empty, ["a"]).count() == 0
    assert sets.sinter(empty.select("key", "member"), ["a", "b"]).count() == 0
    assert timeseries.ts_get(spark.createDataFrame([], "key string, ts long, value double")).count() == 0


def test_hash_deadlines(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    t = spark.createDataFrame([("k", "f", "1", None), ("k", "g", "2", None)], "key string, field string, value string, field_expire_at timestamp")
    later = hashes.hexpire(t, t.where("field = 'f'"), F.timestamp_millis(F.unix_millis(now) + 1999))
    asked = spark.createDataFrame([("k", "f"), ("k", "g"), ("k", "h")], "key string, field string")
    assert dict((f, x) for f, x in col(hashes.httl(later, asked, now), "field", "ttl")) == {"f": 1, "g": -1, "h": -2}
    assert hashes.live_fields(later, F.lit("2024-01-02").cast("timestamp")).count() == 1
    assert hashes.hrandfield(t, -5, 1).count() == 5


def test_streams(spark):
    t = spark.createDataFrame([("s", 1, 0), ("s", 1, 1), ("s", 2, 0), ("s", 3, 0)], "key string, ms long, seq long")
    groups = spark.createDataFrame([("s", "g", 0, 0)], "key string, grp string, last_ms long, last_seq long")
    now = F.lit("2024-01-01").cast("timestamp")
    given, pending, moved = streams.xreadgroup(t, groups, "c", now, 2)
    assert given.count() == 2 and col(moved, "last_ms", "last_seq") == [(1, 1)]
    again = streams.xreadgroup(t, moved, "c", now, 9)[0]
    assert sorted(col(again, "ms", "seq")) == [(2, 0), (3, 0)]
    assert streams.xack(pending, spark.createDataFrame([("s", "g", 1, 0)], "key string, grp string, ms long, seq long")).count() == 1
    assert sorted(col(streams.xrange(t, "1-1", "2"), "ms", "seq")) == [(1, 1), (2, 0)]
    logged = spark.createDataFrame([("s", 5, 0, 1), ("s", 4, 0, 2), ("s", 5, 1, 3)], "key string, ms long, seq long, n long")
    assert sorted(col(streams.accepted(logged), "n")) == [(1,), (3,)]


def test_json(spark):
    t = spark.createDataFrame([("a", '{"x":{"y":[1,2,3]},"s":"hé"}'), ("b", None), ("c", "broken")], "key string, doc string")
    assert dict(col(jsondoc.arrlen(t, "x.y"), "key", "n"))["a"] == 3
    assert dict(col(jsondoc.type_of(t, "$.x"), "key", "type"))["a"] == "object"
    assert dict(col(jsondoc.strlen(t, "s"), "key", "length"))["a"] == 3
    assert dict(col(jsondoc.get(jsondoc.delete(t, "x.y[1]"), "x.y"), "key", "value"))["a"] == "[1,3]"
    assert dict(col(jsondoc.get(jsondoc.arr_pop(t, "x.y", 0), "x.y"), "key", "value"))["a"] == "[2,3]"
    assert dict(col(jsondoc.get(jsondoc.set_path(t, "x.z", 1, only_old=True), "x.z"), "key", "value"))["a"] is None
    assert dict(col(jsondoc.get(jsondoc.num_incr(t, "x.y[0]", 4), "x.y[0]"), "key", "value"))["a"] == "5"
    assert dict(col(jsondoc.str_append(t, "s", "!"), "key", "doc"))["c"] == "broken"


def test_search_grammar():
    assert search.parse("a b|c").kind == "or"
    assert search.parse("-(a b)").kind == "not"
    assert search.parse("@t:{ X }").value == "t:x"
    assert search.parse('"two words"').kind == "and"
    for bad in ("", "(a", "a )", "|"):
        with pytest.raises(ValueError):
            search.parse(bad)


def test_sketches(spark):
    rows = spark.range(20000).select(F.lit("k").alias("key"), (F.col("id") % 7000).alias("item"))
    n = sketches.pfcount(sketches.pfadd(rows)).first()["n"]
    assert abs(n - 7000) < 0.05 * 7000
    bits_, hashes_ = sketches.bloom_size(0.01, 7000)
    bloom = sketches.bf_add(rows, bits_, hashes_)
    asked = spark.range(14000).select(F.lit("k").alias("key"), F.col("id").alias("item"))
    got = sketches.bf_exists(bloom, asked, bits_, hashes_)
    assert got.where("item < 7000 and maybe = 0").count() == 0
    assert got.where("item >= 7000 and maybe = 1").count() < 0.05 * 7000
    assert sketches.bf_info(bloom, bits_, hashes_).first()["error"] < 0.02
    top = sketches.topk_approx(rows.withColumn("item", F.when(F.col("item") < 3500, 0).otherwise(F.col("item"))), 1)
    assert top.first()["item"] == 0
    q = sketches.quantiles(rows.withColumn("value", F.col("item").cast("double")), [0.5]).first()["q0"]
    assert abs(q - 3333) < 100


def test_vectors(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0])], "id long, embedding array<double>")
    assert col(vectors.vssearch(t, [1.0, 0.0], 2), "id") == [(1,), (4,)]
    assert col(vectors.vssearch(t, [1.0, 0.0], 1, "dot"), "id") == [(4,)]
    assert col(vectors.vsrange(t, [0.0, 0.0], "euclidean", 1.0).orderBy("id"), "id") == [(1,), (2,), (3,)]
    assert vectors.vsquery(t, [1], 2).orderBy("rank").first()["id"] == 4


def test_keys(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    t = spark.createDataFrame([("a", "zset"), ("b", "set")], "key string, type string").withColumn("expire_at", F.lit(None).cast("timestamp"))
    gone = keyspace.expire(t, t.where("key = 'a'"), now, -1)
    assert col(keyspace.keys(gone, "*", now), "key") == [("b",)]
    assert col(keyspace.rename(t, "none", "b"), "key") == [("a",), ("b",)]
    assert col(keyspace.random_key(t, 3), "key")[0][0] in ("a", "b")
    assert keyspace.flush(t).count() == 0
    one = spark.range(1).select(keyspace.slot(F.lit("{tag}1")).alias("x"), keyspace.slot(F.lit("tag")).alias("y")).first()
    assert one["x"] == one["y"]


def test_log_fold(spark):
    rows = [(1, "set", "a", "5"), (2, "incrby", "a", "2"), (3, "setnx", "a", "9"), (4, "setxx", "b", "1"), (5, "setnx", "b", "2"), (6, "del", "b", None), (7, "setxx", "b", "7"), (8, "incrby", "c", "4"), (9, "decrby", "c", "1"), (10, "set", "d", "x"), (11, "del", "d", None), (12, "setnx", "d", "y")]
    t = spark.createDataFrame(rows, "seq long, cmd string, key string, arg string")
    assert dict(col(log.fold_strings(t), "key", "value")) == {"a": "7", "c": "3", "d": "y"}
    again = log.fold_strings(log.compact(log.fold_strings(t)))
    assert dict(col(again, "key", "value")) == {"a": "7", "c": "3", "d": "y"}


def test_log_text_round_trip(spark, tmp_path):
    cmds = spark.createDataFrame([(1, ["set", "k", "v w"]), (2, ["del", "é"])], "seq long, args array<string>")
    text = "".join(r["resp"] for r in log.encode_resp(cmds).orderBy("seq").collect())
    (tmp_path / "log.aof").write_bytes(text.encode())
    back = [list(r["args"]) for r in log.read_resp(spark, str(tmp_path)).orderBy("n").collect()]
    assert back == [["set", "k", "v w"], ["del", "é"]]


def test_parquet_round_trip(spark, tmp_path, hundred):
    tables.write(hundred, str(tmp_path / "z"))
    assert spark.read.parquet(str(tmp_path / "z")).exceptAll(hundred).count() == 0


def test_functions_by_name(spark, hundred):
    r = udfs.Registry(spark)
    r.load("lib", {"top": lambda t, n: zsets.zrange(t, 0, n - 1, reverse=True)})
    assert r.call("top", hundred, 3).count() == 3 and r.list() == [("lib", "top")]
    sha = r.script_load("select :x + 1 as y")
    assert r.evalsha(sha, x=2).first()["y"] == 3 and r.script_exists(sha, "no") == [1, 0]
    r.delete("lib")
    with pytest.raises(KeyError):
        r.call("top")


def test_access(spark):
    t = spark.createDataFrame([("u", "get", "a:1"), ("u", "set", "a:1"), ("u", "get", "b:1"), ("v", "set", "b")], "user string, cmd string, key string")
    checked = allowed(t, "u", ["get"], ["a:*"])
    assert sorted(col(refused(checked), "cmd", "n")) == [("get", 1), ("set", 1)]


def test_live_queue_and_deadlines(spark, tmp_path):
    spark.createDataFrame([("q", 1, "pop", "me"), ("q", 2, "push", "x"), ("q", 3, "push", "y"), ("q", 4, "pop", "you")], "key string, n long, kind string, value string").coalesce(1).write.parquet(str(tmp_path / "q.parquet"))
    got = live.run_available(live.queue(live.read(spark, str(tmp_path / "q.parquet"))))
    assert sorted(col(got, "who", "value")) == [("me", "x"), ("you", "y")]
    spark.sql("select 'k' as key, 'v' as value, timestamp '2024-01-01 00:00:00' as ts").coalesce(1).write.parquet(str(tmp_path / "w.parquet"))
    got = live.run_available(live.expiring(live.read(spark, str(tmp_path / "w.parquet")), 1000))
    assert ("k", "set") in col(got, "key", "event")


def test_live_windows(spark, data):
    e = live.read(spark, f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = live.run_available(live.tumble(e, "ts", "1 day", "1 hour", ["event_type"], F.count("*").alias("n")), "complete")
    assert sum(r["n"] for r in got.collect()) == spark.read.parquet(f"{data}/events.parquet").count()


def test_catalogue(spark):
    from keyloom.plans.commands import catalogue

    got = catalogue(spark)
    assert got.where("family = 'zsets' and name = 'zrange'").count() == 1 and got.count() > 200
