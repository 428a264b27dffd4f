import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_print(text, size=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, ids, max_bits):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    lowest = {}
    for i, d in enumerate(ids):
        if d is not None:
            lowest[root(i)] = min(lowest.get(root(i), d), d)
    return [lowest.get(root(i)) for i in range(len(ids))]


def test_fingerprint_matches_definition():
    for text in ["", " \t", "one", "One two  three", "a b c d", "a b c d " * 40, "É a B c\x0bd e\nf", None]:
        got = simhash.fingerprint(simhash.shingle_hashes(None if text is None else text.encode(), 4))
        assert got == brute_print(text)


@pytest.mark.parametrize("block", [200_000, 3])
def test_groups_equal_brute_force(spark, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([2, 6, 60, 150]))]
        for _ in range(rng.choice([1, 1, 3, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", None, "  ", "x" * 50_000, "same same"] + ["same same"] * 3
    ids = [7 * i % 1009 for i in range(len(texts))]
    ids[3] = None
    ids[10] = ids[11]
    rows = [(d, t, "en", "s", 1) for d, t in zip(ids, texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    prints = [brute_print(t) for t in texts]
    want = sorted(map(repr, zip(ids, (f"{p:016x}" for p in prints), brute_components(prints, ids, 4))))
    if block == 200_000:
        got = [tuple(r) for r in simhash.query(docs).collect()]
    else:
        groups = simhash.near_groups(docs, shingle=4, max_bits=4, block=block).collect()
        got = [(r.doc_id, f"{r.f0 & (1 << 64) - 1:016x}", r.component_id) for r in groups]
    assert sorted(map(repr, got)) == want


def test_ring_finds_every_pair_within_its_distance():
    rng = np.random.default_rng(3)
    for tau in (4, 7, 12):
        ring = simhash.Ring(tau)
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        prints = [int(b) for b in base]
        for b in base:
            x = int(b)
            for bit in rng.choice(64, tau, replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
        prints = np.array(prints, np.uint64)
        for more in range(0, 3 if tau < 12 else 4):
            rows = [(s, int(simhash._turned(prints[i : i + 1], ring.starts[s])[0]) >> (64 - ring.widths[s]), i) for s in range(ring.m) for i in range(len(prints))]
            start = np.array([r[0] for r in rows])
            group = np.array([r[0] << 32 | r[1] for r in rows])
            at = np.array([r[2] for r in rows])
            zero = np.zeros(len(rows), int)
            a, b = simhash.link_rows(ring, more, start, group, zero, zero > 0, [prints[at]], at, 0)
            joined = {(int(x), int(y)) for x, y in zip(a, b)}
            assert all((60 + i, i) in joined for i in range(60)), (tau, more)


def test_one_row_of_each_group_stays(spark, documents):
    rows = [(3, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "other words stand in this text", "en", "s", 1), (None, "a b c d e f", "en", "s", 1)]
    kept = simhash.near_dedup(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.query(spark.createDataFrame([], DOCS)).count() == 0
    # an id of two texts, equal rows, and rows without an id; columns of any name pass through
    a, b, c = "a b c d e f", "other words stand in this text", "nobody has the words of these"
    docs = documents([a, a, b, c, c, c], [1, 2, 2, None, None, None], extra=True)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text, r._gone, r._row) for r in kept.collect())) == [(0, c, "_gone", "_row"), (1, a, "_gone", "_row"), (2, b, "_gone", "_row")]


def test_common_keys_are_joined_like_others(spark, monkeypatch):
    from tessera.llm import components

    monkeypatch.setattr(components, "_COMMON_ROWS", 3)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(40)}, **{i: 100 for i in range(100, 121)}}
    rows, one = spark.createDataFrame([(1,)] * 9 + [(2,), (3,)], "k long"), spark.createDataFrame([(1, 9, "x"), (2, 1, "y")], "k long, n long, w string")
    assert sorted(tuple(r) for r in components.join_spread(rows, one, ["k"], "n", 11).select("k", "w").collect()) == [(1, "x")] * 9 + [(2, "y")]
