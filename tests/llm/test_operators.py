"""Operators of the subpackage against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import bpe, chats, components, fingerprint, langid, licenses, mixing, secrets, similar, simhash, topk, urls

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, source string, lang string"
#: Null and empty values, ties, a repeated row, a long text.
ODD = [
    (1, "one two three four five six", "a", "en"),
    (1, "one two three four five six", "a", "en"),
    (2, None, None, None),
    (3, "", "b", "de"),
    (None, "token = abcdef1234567890abcdef1234567890", "b", None),
    (4, "x " * 60_000, "c", "en"),
    (5, "一二三 😀\n\t all rights reserved", "", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("taken", F.lit(7)).withColumn("secrets", F.lit("own")).withColumn("ids", F.lit("own"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# --- BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    with open(VOCABULARY, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@given(st.one_of(st.text(), st.text("ab'st <|>é1\x0b\u2003"), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "ha", "Straße", "ſ", "İ", "Σ", " "])).map("".join)))
@settings(max_examples=300, deadline=None)
def test_bpe_codes_as_the_library(coder, library, text):
    ids = coder.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_table(odd, none, library):
    got = bpe.encode(odd, VOCABULARY).collect()
    want = sorted((i or -1, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
    assert next(r for r in got if r["doc_id"] == 2)["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(none, VOCABULARY).count() == 0


# --- top-k ---------------------------------------------------------------------


def best(rows, every, k):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1.5, -0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [1.0] * 6), (500, [1.0, 2.0])]
    monkeypatch.setattr(topk, "QUERY_BYTES", 150)
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own"))
    assert sorted(tuple(r) for r in topk.search(t).collect()) == best(rows, 50, 5)
    assert topk.search(t.limit(0)).count() == 0
    few = [(0, [1.0]), (1, [2.0])]
    assert [tuple(r) for r in topk.search(spark.createDataFrame(few + few, "vec_id long, embedding array<float>")).collect()] == best(few, 50, 5)


def test_tree_prunes_and_stays_exact():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(-256, 256, (4000, 8))
    ids = np.arange(4000)
    q = rows[:40]
    found, score = np.full((40, 5), 1 << 60), np.full((40, 5), topk.NONE)
    topk.Tree(ids, rows).search(ids[:40], q, score, found, np.full(40, topk.NONE))
    for i in range(40):
        s = rows @ q[i]
        want = sorted((-x, j) for j, x in enumerate(s.tolist()) if j != i)[:5]
        assert [(-a, b) for a, b in zip(score[i].tolist(), found[i].tolist(), strict=True)] == want


# --- secrets --------------------------------------------------------------------


def base_spans(t):
    word = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = rf"""({word}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_base_spans(spark):
    rnd = random.Random(4)
    parts = ["Token", "secret", "API_KEY", "apikey", "passwd", ":", "=", " = ", "'", '"', "AKIA", "é😀", " hello ", "abc12", "some-very-long-slug-of-words-2024-05"]
    texts = []
    for i in range(600):
        p = [rnd.choice([*parts, "".join(rnd.choices("0123456789abcdef", k=rnd.choice([5, 23, 24, 40]))), "".join(rnd.choices(string.ascii_uppercase + string.digits, k=rnd.choice([15, 16, 20])))]) for _ in range(rnd.randint(0, 8))]
        texts.append((i, "".join(p)))
    got = {r["doc_id"]: r["secrets"] for r in secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, t in texts:
        spans = [(s["start"], s["rank"], s["end"]) for s in got[i]]
        assert [s for s in spans if s[1] < 3] == base_spans(t)
        assert all(t[s["start"] : s["end"]] == s["value"] for s in got[i])
        assert spans == sorted(spans)


def test_secret_battery(spark):
    rnd = random.Random(7)
    keys = ["".join(rnd.choices(string.ascii_letters + string.digits + "+/", k=44)) for _ in range(60)]
    words = ["/en/some-article-about-gardening-2024", "internationalization2024strategies", "AAAAAAAAAAAAAAAAAAAAAAAA1", "abcdefghijklmnopqrstuvwxyz0123456789"]
    t = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {w} there") for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["secrets"] if s["rank"] == 3] for r in secrets.scan(t).collect()}
    assert sum(got[i] == [k] for i, k in enumerate(keys)) >= 54
    assert all(not got[100 + i] for i in range(len(words)))


def test_redaction(odd, none):
    rows = {r["doc_id"]: r["text"] for r in secrets.redact(odd).collect()}
    assert rows[None] == "[secret]" and rows[2] is None and rows[3] == "" and rows[4] == "x " * 60_000
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(none).count() == 0


# --- licences ------------------------------------------------------------------


def test_license_phrases():
    rnd = random.Random(3)
    s = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    voc = "cc by general public license all rights reserved the mit x".split()
    for _ in range(3000):
        ws = [rnd.choice(voc) for _ in range(rnd.randint(0, 30))]
        n, hits, _ = s.scan(" ".join(ws).encode())
        want = [(i, k) for k, p in enumerate(licenses.PHRASES) for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        assert n == len(ws) and sorted(hits) == sorted(want)


def test_license_matching_statistics():
    """At every word the automaton holds the longest template passage that ends there."""
    s = licenses.Scanner({}, [("a", "p q r s p q"), ("b", "q r p q s")])
    whole = [t.split() for t in ("p q r s p q", "q r p q s")]
    rnd = random.Random(5)
    for _ in range(300):
        ws = [rnd.choice("pqrsx") for _ in range(12)]
        state = size = 0
        for i, w in enumerate(ws):
            code = s.vocabulary.get(w.encode())
            while state and code not in s.machine.step[state]:
                state = s.machine.link[state]
                size = s.machine.length[state]
            if code in s.machine.step[state]:
                state, size = s.machine.step[state][code], size + 1
            want = max((n for n in range(i + 2) if any(t[j : j + n] == ws[i + 1 - n : i + 1] for t in whole for j in range(len(t)))), default=0)
            assert size == want


def test_license_templates(spark, odd, none):
    t = spark.createDataFrame([(i, f"first words. {text} last words") for i, (_, text) in enumerate(licenses.TEMPLATES)] + [(99, "permission to use free software of any kind")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(t).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i]["labels"].split(",") and got[i]["score"] > 0.99
    assert got[99]["labels"] == "" and got[99]["score"] < licenses.COVER
    edge = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert edge[5]["base_labels"] == "reserved" and (edge[5]["first_word"], edge[5]["n_words"]) == (2, 5)
    assert edge[2]["n_words"] == 0 and edge[2]["first_word"] is None and licenses.scan(none).count() == 0


# --- fingerprints --------------------------------------------------------------


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_word_hashes_follow_words(text):
    raw = text.encode()
    words = raw.lower().split()
    got = fingerprint.word_hashes(raw).tolist()
    assert len(got) == len(words)
    assert got == [fingerprint.word_hashes(w).tolist()[0] for w in words]


def test_likeness_is_near_the_true_one():
    rnd = random.Random(6)
    errors = []
    for _ in range(150):
        a = [f"w{rnd.randrange(10**9)}" for _ in range(rnd.randint(20, 600))]
        b = list(a)
        for i in range(rnd.randint(0, len(a) // 6)):
            b[rnd.randrange(len(b))] = f"v{i}"
        x, y = (" ".join(t).encode() for t in (a, b))
        s, t = (set(fingerprint.shingles(v).tolist()) for v in (x, y))
        errors.append(fingerprint.likeness(fingerprint.fingerprint(x), fingerprint.fingerprint(y)) - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_neighbours(spark, odd, none):
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.neighbours(odd).collect()), key=str)
    rows = sorted([(i, t or "") for i, t, *_ in ODD], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((i is None, i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert fingerprint.neighbours(none).count() == 0
    one = fingerprint.neighbours(odd.where("doc_id = 3")).first()
    assert (one["near_next"], one["n_chars"], one["fingerprint"]) == (1.0, 0, "")


def test_neighbours_over_many_ranges(spark, documents):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.neighbours(documents).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()


# --- SimHash -------------------------------------------------------------------


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return v - (1 << 64) if v >> 63 else v


@given(st.text("aB \tcİé", max_size=80))
@settings(max_examples=150, deadline=None)
def test_simhash(text):
    assert simhash.simhash(text.encode()) == slow_simhash(text)


def groups(fps, near=2):
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], np.int64).view(np.uint64)
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= near):
            a, b = root(i), root(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def test_links_find_all_groups(spark):
    rnd = random.Random(5)
    fps = set()
    for n in (1, 2, 5, 1, 400):
        for z in [rnd.getrandbits(64) for _ in range(60 if n < 9 else 1)]:
            for _ in range(n):
                v = z
                for _ in range(rnd.choice([0, 1, 2, 3])):
                    v ^= 1 << rnd.randrange(64)
                fps.add(v - (1 << 64) if v >> 63 else v)
    t = spark.createDataFrame([(v,) for v in fps], "fp long")
    root = {r["node"]: r["root"] for r in components.components(simhash.links(t)).collect()}
    assert {v: root.get(v, v) for v in fps} == groups({v: v for v in fps})


def test_components_of_a_long_path(spark):
    e = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r["node"]: r["root"] for r in components.components(e.repartition(8)).collect()}
    assert got == {i: 0 for i in range(1, 301)}


def test_near_duplicates(spark, documents, odd, none):
    got = simhash.near_duplicates(documents).collect()
    want = groups({r["doc_id"]: r["fp"] for r in got})
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    edge = simhash.near_duplicates(odd).collect()
    assert len(edge) == len(ODD) and {r["component_id"] for r in edge if r["doc_id"] in (2, 3)} == {2}
    kept = simhash.keep_one(odd, simhash.near_duplicates(odd))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "None"]
    assert simhash.near_duplicates(none).count() == 0


def test_near_copies(spark, odd, none):
    rnd = random.Random(8)
    rows, base = [], {}
    for g in range(80):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}" for _ in range(rnd.randint(80, 300))]
        base[len(rows)] = g
        rows.append((len(rows), " ".join(words)))
        for _ in range(2):
            other = list(words)
            for _ in range(max(1, len(words) // 60)):
                other[rnd.randrange(len(other))] = f"new{rnd.randrange(10**6)}"
            base[len(rows)] = g
            rows.append((len(rows), " ".join(other)))
    sets = {i: set(fingerprint.shingles(t.encode()).tolist()) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [(i, j) for i in got for j in got if i < j and base[i] == base[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(close) > 50 and sum(got[i] == got[j] for i, j in close) >= 0.95 * len(close)
    assert all(base[i] == base[c] for i, c in got.items())
    edge = {r["doc_id"]: r["component_id"] for r in similar.near_copies(odd).collect()}
    assert edge == {1: 1, 2: 2, 3: 2, None: None, 4: 4, 5: 5}
    assert similar.near_copies(none).count() == 0


def test_near_copies_among_texts_with_a_common_passage(spark):
    """Each text has one edited copy, and shares two thirds of its words with all the others."""
    rnd = random.Random(18)
    word = lambda: f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}"
    passage = [word() for _ in range(120)]
    rows = []
    for g in range(2000):
        own = [word() for _ in range(60)]
        edited = list(own)
        for at in rnd.sample(range(60), 3):
            edited[at] = word()
        rows += [(2 * g, " ".join(passage + own)), (2 * g + 1, " ".join(passage + edited))]
    sets = {i: set(fingerprint.shingles(t.encode()).tolist()) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close = [i for i in range(0, 4000, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(close) > 1000 and sum(got[i] == got[i + 1] for i in close) >= 0.95 * len(close)
    assert sum(c // 2 != i // 2 for i, c in got.items()) <= 0.01 * len(rows)


def test_near_copies_hold_all_links_of_simhash(spark):
    """Texts of one much repeated line and different ends: within two bits of 64, far apart on 512."""
    rnd = random.Random(28)
    rows = []
    for g in range(20):
        line = " ".join(f"line{g}x{k}" for k in range(9))
        for _ in range(3):
            end = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
            rows.append((len(rows), f"{line} " * 60 + end))
    t = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(t).collect()}
    assert exact == {i: i - i % 3 for i in exact}
    wide = np.array([similar.wide(text.encode()) for _, text in rows]).view(np.uint64)
    apart = np.bitwise_count(wide[::3] ^ wide[1::3]).sum(axis=1)
    assert apart.min() > similar.NEAR
    assert {r["doc_id"]: r["component_id"] for r in similar.near_copies(t).collect()} == exact


def test_pigeonhole_of_wide_fingerprints_is_exact(spark):
    """No pair up to 35 bits apart is lost, wherever the bits are: here each of 34 samples of 14 bits has one of them."""
    left = [set(np.random.default_rng(1000 + k).choice(64 * similar.WORDS, 14, replace=False).tolist()) for k in range(34)]
    hit = []
    while left:
        hit.append(max(range(64 * similar.WORDS), key=lambda b: sum(b in x for x in left)))
        left = [x for x in left if hit[-1] not in x]
    assert len(hit) <= 35
    rng = np.random.default_rng(6)
    rows = []
    for i in range(100):
        bits = rng.integers(0, 2, 64 * similar.WORDS, dtype=np.uint8)
        other = bits.copy()
        other[hit if i % 2 else rng.choice(len(bits), 35, replace=False)] ^= 1
        rows += [(2 * i + k, np.packbits(x, bitorder="little").view(np.int64).tolist()) for k, x in enumerate((bits, other))]
    fps = spark.createDataFrame(rows, "node long, fp array<long>")
    found = similar._chunked(similar._meet(similar._dealt(fps, len(rows)), similar.HOT)).collect()
    assert {(r["u"], r["v"]) for r in found} == {(2 * i, 2 * i + 1) for i in range(100)}
    for n in (0, 1 << 18, 1 << 21, 1 << 24):
        bits, count = similar.probes(n)
        groups = similar.bit_groups(n, np.array([fp for _, fp in rows]))
        whole = 64 * similar.WORDS // bits
        assert len(groups) == max(whole, count) and sorted(b for g in groups[:whole] for b in g) == list(range(64 * similar.WORDS))


def test_all_rows_of_a_bucket_are_compared():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (40, similar.WORDS)).astype(np.uint64)
    flip = np.zeros(similar.WORDS, np.uint64)
    flip[-1] = np.uint64((1 << 60) - 1)
    words = np.concatenate([base, base ^ flip, base[:1] ^ flip ^ np.roll(flip, 1)])
    apart = np.bitwise_count(words[:, None] ^ words[None, :]).sum(axis=2)
    want = np.where(apart <= similar.NEAR, np.arange(len(words)), len(words)).min(axis=1)
    assert similar.alike(words).tolist() == [*range(40), *range(40), 0] and want[80] == 40
    for size in (1, 2, 7, 60):
        slot = np.repeat(np.arange(len(words) // size + 1), size)[: len(words)]
        got = {(u, v) for u, v in zip(*similar.met(slot, np.arange(len(words)), words), strict=True)}
        near = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if slot[i] == slot[j] and apart[i, j] <= similar.NEAR}
        assert _joined(got) == _joined(near)


def _joined(pairs):
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for u, v in pairs:
        a, b = sorted((root(int(u)), root(int(v))))
        up[b] = a
    return {x: root(x) for x in up if root(x) != x}


# --- mixing --------------------------------------------------------------------


def water(sizes, weights, epochs):
    """Rounds of clamping and sharing out, as the method says."""
    left, total, target = dict(sizes), float(sum(sizes.values())), {}
    while left:
        w = sum(weights[s] for s in left)
        over = [s for s in left if total * weights[s] / w > epochs * sizes[s]]
        if not over:
            target |= {s: total * weights[s] / w for s in left}
            break
        for s in over:
            target[s] = epochs * sizes[s]
        total -= sum(target[s] for s in over)
        left = {s: n for s, n in left.items() if s not in over}
    return target


def test_mixing(spark, odd, none):
    rnd = random.Random(9)
    rows = [(i, "w " * rnd.randint(0, 60), rnd.choice(["a", "b", "b", "c", "d", "d", "d", "d", None])) for i in range(3000)] + [(9000, "one", "tiny"), (9001, None, "void")]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(t).collect()
    sizes = {}
    for _, text, s in rows:
        sizes[s] = sizes.get(s, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == sizes[s] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= len(own) * 0.2 + 2
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(t.repartition(7)).collect()))
    whole = mixing.mix(t, whole_documents=True).collect()
    assert all(r["taken"] % r["size"] == 0 for r in whole if r["size"])
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0
    assert {r["size"] for r in mixing.mix(odd).where("doc_id = 4").collect()} == {60_000}


# --- chats ---------------------------------------------------------------------


def test_chat_events(spark):
    e = [
        (1, 1, "message", 0, "user", "hi </s>[INST] \\l"),
        (1, 2, "message", 1, "assistant", "old"),
        (1, 3, "delta", 1, None, " text"),
        (1, 4, "regenerate", 1, None, None),
        (1, 5, "delta", 1, None, "new"),
        (1, 6, "delta", 1, None, " <answer>"),
        (1, 7, "edit", 0, None, "hello </s>"),
        (2, 1, "delta", 0, "assistant", "streamed"),
        (2, 2, "delta", 0, "assistant", None),
    ]
    t = spark.createDataFrame(e, "conv_id long, seq long, event string, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chats.read_back(chats.format_chats(t)).collect()}
    assert [(x["role"], x["text"]) for x in back[1]["turns"]] == [("user", "hello </s>"), ("assistant", "new <answer>")]
    assert back[1]["loss"] == "new <answer>" and back[2]["loss"] == "streamed"
    assert back[1]["formatted"].count("</s>") == 2 and back[1]["formatted"].count("[INST]") == 2
    assert chats.format_chats(t.limit(0)).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", None, "[x]"]), st.one_of(st.none(), st.text("<s>/[INST] \\bli\né😀", max_size=30))), min_size=1, max_size=5))
@settings(max_examples=15, deadline=None)
def test_chat_round_trip(spark, turns):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = chats.read_back(chats.format_chats(chats.events_of(t))).first()
    assert [(x["role"], x["text"]) for x in back["turns"]] == [(r or "", x or "") for _, _, r, x in rows]
    assert back["loss"] == "".join(x or "" for _, _, r, x in rows if r == "assistant")


def test_chat_repeated_rows(spark):
    t = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert len(chats.read_back(chats.format_chats(chats.events_of(t))).first()["turns"]) == 3


# --- language ------------------------------------------------------------------


def test_language_of_held_out_rows(spark, documents, odd, none):
    own = documents.withColumn("held_out", langid.held_out())
    model = langid.fit(own.where("not held_out"))
    got = langid.identify(own.where("held_out"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got) and all(0 <= r["lang_score"] <= 1 for r in got)
    edge = {r["doc_id"]: r for r in langid.identify(odd.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert edge[2]["lang_pred"] == edge[3]["lang_pred"] == "und" and edge[4]["lang_pred"] in model.languages
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(none)
    assert empty.languages == [] and langid.identify(odd, empty).first()["lang_pred"] == "und"
    again = langid.fit(own.where("not held_out").repartition(5))
    assert np.array_equal(model.logs, again.logs)


# --- URLs ----------------------------------------------------------------------

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://Example.COM/en/x?y#z", "example.com", "/en/x", "example.com/en/", "block"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/q", "a.www.example.com", "/en/q", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("x://net/es/?u=http://a", "net", "/es/", "net/es/", "block"),
    ("http://bad.org/p/", "bad.org", "/p/", None, "block"),
    ("http://bad.org/q", "bad.org", "/q", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://ÄB.org/p", "Äb.org", "/p", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    t = spark.createDataFrame([(1, url, "own"), (1, url, "own")], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("bad.org/p",), (None,), ("bad.org/p",)], "u string")
    got = urls.judge(t, RULES, listed).collect()
    assert len(got) == 2 and all((r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict) for r in got)


def test_filter_has_no_false_negatives_and_few_false_hits(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h.org/"), F.col("id")).alias("k"))
    words, blocks = urls.bloom(keys.where("substring(k, 7) % 2 = 0"), "k")
    got = keys.select("k", urls.maybe_listed(F.col("k"), words, blocks).alias("m")).collect()
    even = [r["m"] for r in got if int(r["k"][6:]) % 2 == 0]
    odd_ = [r["m"] for r in got if int(r["k"][6:]) % 2]
    assert all(even) and sum(odd_) < 0.05 * len(odd_)
    assert urls.judge(keys.limit(0).withColumn("url", F.col("k")), RULES, keys.limit(0)).count() == 0
