import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import line_dedup


def key_of(line):
    stripped = line.strip(" \t\n\v\f\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)


def brute(texts, min_docs=10, min_chars=1):
    lines = [(t or "").split("\n") for t in texts]
    df = Counter(k for ls in lines for k in {key_of(x) for x in ls} if len(k) >= min_chars)
    out = []
    for ls in lines:
        kept = [x for x in ls if df[key_of(x)] < min_docs]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def corpus():
    rng = random.Random(3)
    common = ["Share this page", "  share THIS page\t", "Ünïcode Zeile", "x", "é", "\x0b Cookies \x0c", "a b" * 4000]
    texts = []
    for i in range(60):
        texts.append("\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(300)}" for _ in range(rng.randrange(1, 12))))
    return [*texts, None, "", "\n", "\n\n \n", "Share this page", "share this page\nshare this page"]


@pytest.mark.parametrize("broadcast_mb", [64, 0])
@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (3, 2), (1, 1)])
def test_equals_brute_force(documents, broadcast_mb, min_docs, min_chars):
    texts = corpus()
    ids = list(range(len(texts)))
    ids[5] = ids[6]
    ids[7] = None
    rows = line_dedup.dedup_lines(documents(texts, ids, extra=True), min_docs, min_chars, broadcast_mb=broadcast_mb).collect()
    want = brute(texts, min_docs, min_chars)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in rows]
    assert sorted(got, key=repr) == sorted([(i, *w) for i, w in zip(ids, want)], key=repr)
    assert all(r.node == "node" and r.h1 == "h1" and r.blob == "blob" for r in rows)


@pytest.mark.parametrize("broadcast_mb", [64, 0])
def test_many_chunks_and_shards(documents, monkeypatch, broadcast_mb):
    monkeypatch.setattr(line_dedup, "CHUNK_BITS", 2)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "FLUSH", 7)
    texts = corpus()
    rows = line_dedup.dedup_lines(documents(texts, extra=True), 3, 1, broadcast_mb=broadcast_mb).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in rows) == [(i, *w) for i, w in enumerate(brute(texts, 3))]


def test_query_columns(documents):
    texts = corpus()
    rows = line_dedup.query(documents(texts)).collect()
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, (n, d, t) in enumerate(brute(texts))}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want


def test_empty_table(spark):
    assert line_dedup.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    a[:50] = a[50:100]  # equal first halves still have their own slots
    counts = rng.integers(1, 1000, 20_000)
    table = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(a, b, counts).dump())
    assert sorted(table._index(a, b).tolist()) == list(range(20_000))
    assert (table.count(a, b) == counts).all()
    assert not table.count(a, b ^ np.uint64(1)).any()
    assert not line_dedup.PerfectHash.build(a[:0], b[:0], counts[:0]).count(a[:3], b[:3]).any()
