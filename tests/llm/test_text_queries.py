"""Queries of the operators against their SQL or a slow version, and the pipeline against brute force."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from oracle import assert_same, connect
from tokenizers import Tokenizer

from keyloom.llm import fingerprint, langid
from keyloom.llm.queries import ORACLE_SQL, QUERIES, vocabulary


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, data, name):
    assert_same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op1_bpe", "op3_secrets", "op4_licenses", "op5_fingerprints", "op6_simhash", "op9_language"])
def test_query_gives_a_row_for_each_document(spark, data, name):
    ids = [r["doc_id"] for r in QUERIES[name](spark, data).collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").collect())


def test_encoding_of_a_whole_table_is_the_library_s(spark, data):
    """``op1_bpe`` over all documents, digest by digest."""
    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op1_bpe"](spark, data).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_simhash_groups_against_brute_force(spark, data):
    """``op6_simhash`` over all documents: prints by their definition, groups by comparing all."""
    import xxhash

    def fingerprint_of(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        if not words:
            return 0
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {r["doc_id"]: fingerprint_of(r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op6_simhash"](spark, data).collect()}
    assert all(got[i]["fingerprint"] == f"{f:016x}" for i, f in want.items())
    root = {i: i for i in want}
    changed = True
    ids = sorted(want)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (want[a] ^ want[b]).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    assert all(got[i]["component_id"] == root[i] for i in ids)


def test_secret_counts(spark, tmp_path):
    rows = [(1, "token = abcdef12 and token=short AKIA" + "A1" * 10), (2, "0123456789abcdef" * 2 + " é 0123456789abcdef" * 3 + "fedcba9876543210"), (3, None), (4, "secret: 'abcdefgh' password=zzzzzzzz")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_secrets"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"]) for r in got} == {1: (1, 1, 0), 2: (0, 0, 2), 3: (0, 0, 0), 4: (2, 0, 0)}
    assert got
    for r in got:
        kinds = [x.split(":")[0] for x in r["spans"].split(",") if x]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        base = ",".join(x for x in r["spans"].split(",") if x.split(":")[0] != "random")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_pipeline(spark, data, tmp_path):
    docs = start = spark.read.parquet(f"{data}/documents.parquet")
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.collect())
        if i < 4:
            assert docs.columns == start.columns
    letters = {r["doc_id"] for r in seen[0] if r["text"] and any(c.isalpha() for c in r["text"])}
    assert {r["doc_id"] for r in seen[1]} == letters
    kept = {r["doc_id"]: set(fingerprint.shingles(r["text"].encode()).tolist()) for r in seen[2]}
    assert len(kept) == len(seen[2]) and set(kept) <= letters
    dropped = [r for r in seen[1] if r["doc_id"] not in kept]
    for r in dropped:
        own = set(fingerprint.shingles(r["text"].encode()).tolist())
        assert max(len(own & s) / len(own | s) for s in kept.values()) > 0.4
    ids = sorted(kept)
    close = sum(len(kept[a] & kept[b]) >= 0.85 * len(kept[a] | kept[b]) for x, a in enumerate(ids) for b in ids[x + 1 :])
    assert close == 0
    before = {r["doc_id"]: r for r in seen[2]}
    for r in seen[3]:
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]]["text"] or "[secret]" in r["text"]
    after = {r["doc_id"]: r for r in seen[3]}
    assert all(r == after[r["doc_id"]] for r in seen[4])
    copies = {i: sum(r["doc_id"] == i for r in seen[4]) for i in after}
    assert max(copies.values()) <= 3
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(seen[4]) - words(seen[3])) < 0.15 * words(seen[3])
    library = Tokenizer.from_file(vocabulary())
    texts = {r["doc_id"]: r["text"] for r in seen[4]}
    assert len(seen[5]) == len(seen[4])
    assert all(list(r["ids"]) == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in seen[5][:300])


def test_pipeline_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_held_out_is_by_crc(spark):
    import zlib

    rows = spark.range(40).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
