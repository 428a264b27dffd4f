import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pytest

from tessera.llm import resample as r


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\s]+", low, re.ASCII)


def test_grams_equal_a_plain_count():
    texts = ["The cat, the CAT. the the the!", "", None, "é ü--x", "a", "x " * 5000, "the cat , the cat . the the the !", "\x01ab\x1cc"]
    joint_bucket, joint_owner = r.Grams().of([t.encode() if t is not None else None for t in texts])
    for i, t in enumerate(texts):
        alone = r.Grams().of([t.encode() if t is not None else None])[0]
        mine = joint_bucket[joint_owner == i]
        assert sorted(mine.tolist()) == sorted(alone.tolist())
        n = len(tokens(t))
        assert len(mine) == max(0, 2 * n - 1), t
    same = lambda a, b: Counter(joint_bucket[joint_owner == a].tolist()) == Counter(joint_bucket[joint_owner == b].tolist())
    assert same(0, 6) and not same(0, 3)


@cache
def bucket(gram):
    """That of one n-gram alone."""
    if isinstance(gram, str):
        return int(r.Grams().of([gram.encode()])[0][0])
    text = " ".join(["x"] * (2 + (1 << gram[1] >> 1)) if gram[0] == "again" else gram)
    return int(r.Grams().of([text.encode()])[0][-1])


def named(text):
    """The set of buckets of a text's n-grams."""
    own, out, run = tokens(text), set(), 0
    for i, word in enumerate(own):
        out.add(word)
        if i:
            run = run + 1 if word == own[i - 1] else 0
            out.add(("again", (run - 1).bit_length()) if run else (own[i - 1], word))
    return set(map(bucket, out))


@pytest.mark.parametrize("doubt", [0, r.DOUBT])
def test_weights_equal_those_of_plain_models(documents, spark, doubt):
    _, docs, labels = made(documents, spark)
    good = r.good_documents(labels).where("good")
    weights = {x.doc_id: x.log_weight for x in r.weigh(docs, r.ratios(docs, good, doubt)).collect()}
    ids, texts = {x.doc_id for x in good.collect()}, {x.doc_id: x.text for x in docs.collect()}
    raw, own = Counter(), Counter()
    for i, text in texts.items():
        raw.update(named(text))
        own.update(named(text) if i in ids else ())
    if doubt:
        mass, at = 0, iter(sorted(raw, key=lambda g: own[g] / raw[g]))
        while mass < sum(own.values()) / 2:
            g = next(at)
            mass += own[g]
        scale = own[g] / raw[g]
    else:
        scale = sum(own.values()) / sum(raw.values())

    def ratio(g):
        e = scale * raw[g]
        plain = np.log((own[g] + 1) / (e + 1))
        return plain / (1 + np.exp(doubt - (own[g] - e) ** 2 / (e + 1) / 2)) if doubt else plain

    for i, text in texts.items():
        assert np.isclose(weights[i], sum(map(ratio, named(text))), atol=1e-6), i


def made(documents, spark, extra=False):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(25)], [f"b{i}" for i in range(25)]
    kinds = [rng.random() < 0.6 for _ in range(300)]
    texts = [" ".join(rng.choice(good if k or rng.random() < 0.4 else bad) for _ in range(rng.randrange(20, 90))) for k in kinds] + [None, "", "z" * 100_000]
    labels = [(i, int(k), 0) for i, k in enumerate(kinds) if i % 2] + [(1, 1, None), (9999, 1, 0), (None, 1, 0)]
    return kinds, documents(texts, extra=extra), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sample_is_the_largest_keys(documents, spark):
    kinds, docs, labels = made(documents, spark, True)
    ratio = r.ratios(docs, r.good_documents(labels).where("good"))
    rows = {x.doc_id: x for x in r.weigh(docs, ratio).collect()}
    for i, x in rows.items():
        text = docs.where(f"doc_id = {i}").first().text if i < 5 else None
        if i < 5:
            assert np.isclose(x.log_weight, ratio[r.Grams().sets([text.encode()])[0]].sum())
        assert np.isclose(x.key, x.log_weight + r.gumbel(i, r.SEED))
    for k in (0, 1, 150, 303, 400):
        kept = {x.doc_id for x in r.resample(docs, labels, k=k).collect()}
        assert kept == set(sorted(rows, key=lambda i: -rows[i].key)[:k])
    kept = {x.doc_id for x in r.query(docs, labels).collect()}
    assert np.mean([kinds[i] for i in kept if i < 300]) > 0.9
    assert sum(kinds[i] for i in kept if i < 300) > 0.9 * sum(kinds)


def test_noise_makes_a_sample_in_proportion():
    draws = np.array([[r.gumbel(i, seed) for i in range(3)] for seed in range(4000)]) + np.log([1, 2, 5])
    first = np.bincount(draws.argmax(axis=1), minlength=3) / 4000
    assert np.allclose(first, [1 / 8, 2 / 8, 5 / 8], atol=0.03)


def test_cases(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(["a b", "a b", None, ""], ids=[1, 1, None, 2])
    assert r.query(docs, none).count() == 4
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], none.schema)
    kept = [x.doc_id for x in r.resample(docs, some, k=1).collect()]
    assert kept in ([1, 1], [None], [2])
    assert r.query(docs.limit(0), some).count() == 0
