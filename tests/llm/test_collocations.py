import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def counted(texts, langs, longest=5):
    n, f = Counter(), Counter()
    for t, lang in zip(texts, langs):
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return n, f


def brute(texts, langs, least, top):
    n, f = counted(texts, langs)
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in candidates.items():
        if any(o == lang and len(x) > len(w) and b == a and any(x[i : i + len(w)] == w for i in range(len(x))) for (o, x), b in candidates.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def sample(seed=3, docs=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a b", "été", "x\x1cy", "und", "zero\x00", "_"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", ". ", ",", "\n", "\x0b", " new york city "]) for _ in range(rng.randrange(0, 80))) for _ in range(docs)]
    return [*texts, None, "", ".,;", "one", texts[0], texts[0]], [rng.choice(["en", "de", None, "und", ""]) for _ in range(docs)] + ["en", None, "fr", "en", "en", "en"]


@pytest.mark.parametrize("least,top", [(2, 10_000), (6, 7)])
def test_equals_brute_force(spark, documents, least, top):
    texts, langs = sample()
    got = collocations.collocations(documents(texts, langs=langs, extra=True), least, top)
    assert sorted(map(tuple, got.collect())) == brute(texts, langs, least, top)


def test_small_shards_and_cuts_within_pieces_lose_nothing(spark, documents, monkeypatch):
    """Shards of a few words: nearly every phrase stands across a cut."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d."]) for _ in range(400)) for _ in range(5)] + ["word" * 200 + " a b", "a b " * 300]
    for size in (16, 50):
        for text in texts:
            parts = list(collocations.cuts(text.encode(), size))
            assert b"".join(p for p, _ in parts) == text.encode().translate(collocations._PLAIN)
    found = collocations.counts(documents(texts), 3)  # cuts() has its size as a default
    _, want = counted(texts, ["en"] * len(texts))
    assert {(r.lang, tuple(bytes(r.phrase).decode().split(" "))): r.n for r in found.where("words > 0").collect()} == {k: n for k, n in want.items() if n >= 3}
    for size in (16, 50):
        parts = [p for t in texts for p in collocations.cuts(t.encode(), size)]
        shard = collocations.Shard("en", parts)
        got = Counter()
        for m, at, n in shard.phrases(2, 5):
            names = shard.names.to_pylist()
            got.update({tuple(names[shard.words[a + k] - 1].decode() for k in range(m)): int(c) for a, c in zip(at, n)})
        assert got == Counter({w: n for (_, w), n in want.items() if len(w) > 1})


def test_a_full_bitmap_changes_no_count(spark, documents, monkeypatch):
    texts, langs = sample(8)
    want = brute(texts, langs, 3, 10_000)
    monkeypatch.setattr(collocations, "bitmap", lambda df: ~collocations.np.zeros(1 << (collocations.BITS - 6), collocations.np.uint64))
    assert sorted(map(tuple, collocations.collocations(documents(texts, langs=langs), 3, 10_000).collect())) == want


def test_a_very_long_text(documents):
    text = "alpha beta gamma " * 600_000  # 10 MB without the end of a piece
    rows = {r.phrase: r for r in collocations.query(documents([text])).collect()}
    assert all(" ".join((["alpha", "beta", "gamma"] * 3)[i : i + 5]) in rows for i in range(3))
    assert rows["alpha beta gamma alpha beta"].a == 599_999 and rows["alpha beta gamma alpha beta"].n == 1_800_000


def test_products_of_more_than_64_bits(spark):
    row = spark.sql("SELECT CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS s FROM VALUES (9876543210123L, 98765432101234567L, 12345678901234L, 9999999999999L) t(a, n, l, r)").first()
    assert row.s == 1000 * 9876543210123 * 98765432101234567 // (12345678901234 * 9999999999999)


def test_an_empty_table(spark, documents):
    assert collocations.query(documents(["x"]).limit(0)).collect() == []
