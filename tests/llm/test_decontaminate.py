import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate as d


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=4):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(40)], [f"r{i}" for i in range(3000)]
    words = common * 30 + rare
    items = [sentence(rng, rng.choice([3, 8, 30, 60, 150]), words) + ("\n" + sentence(rng, 6, words) if rng.random() < 0.5 else "") for _ in range(40)]
    items += ["", None, "one", items[2], " . "]
    texts = []
    for _ in range(80):
        t = sentence(rng, rng.choice([0, 5, 100, 400]), words)
        if rng.random() < 0.5:
            lines = rng.choice([i for i in items if i]).upper().split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                lines[rng.randrange(len(lines))] = "changed"
            t += ", " + "; ".join([" ".join(lines)]) + " " + sentence(rng, rng.choice([0, 70, 200]), words)
        texts.append(t)
    return items, [*texts, None, "", "one", items[3]]


def brute(items, texts, windowed=False):
    found = set()
    for i, item in enumerate(items):
        x = d.Item.of(i, item)
        for t, text in enumerate(texts):
            words = d.words_of(text.encode() if text else None)
            reach = len(x.words)
            spans = [words] if len(words) <= 2 * d.UNIT else [words[max(0, s - max(0, reach - d.UNIT)) : s + 2 * d.UNIT + max(0, reach - d.UNIT)] for s in range(0, len(words), d.UNIT)]
            if any(x.verified(s, d.OVERLAP, d.PART_OVERLAP) for s in spans):
                found.add((t, i))
    return found


@pytest.mark.parametrize("max_units", [20_000, 7])
def test_finds_what_brute_force_finds(documents, spark, max_units):
    items, texts = corpus()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(texts, extra=True)
    rows = d.leaks(docs, bench, max_units=max_units).collect()
    want = brute(items, texts)
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) and len(want) > 20
    kept = d.clean(docs, bench, max_units=max_units)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {t for t, _ in want}
    assert kept.columns == docs.columns


def test_scores_are_the_same_for_any_number_of_indexes(documents, spark):
    items, texts = corpus(6)
    bench, docs = spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), documents(texts)
    one, many = (sorted(tuple(r) for r in d.leaks(docs, bench, max_units=n).collect()) for n in (20_000, 9))
    assert one == many and len(one) > 20


def test_retrieval_equals_scoring_everything():
    items, texts = corpus(9)
    index = d.Index([d.Item.of(i, t) for i, t in enumerate(items)])
    rng = np.random.default_rng(0)
    windows = rng.integers(0, len(index.term) + 1, (300, 2 * d.UNIT)).astype(np.int32)
    for k in range(100):  # windows made of units' own words
        own = [index.term[w] for w in index.items[k % len(index.items)].words][: 2 * d.UNIT]
        windows[k, : len(own)] = own
    dense = np.zeros((len(index.term) + 1, len(index.needed)))
    for t in range(len(index.term)):
        for run in range(index.term_start[t], index.term_start[t + 1]):
            for e in range(index.run_start[run], index.run_start[run] + index.run_size[run]):
                dense[t, index.places[e]] = index.weights[e]
                assert index.places[e] // d.BLOCK == index.run_block[run] and index.weights[e] <= index.run_most[run]
    scores = np.array([dense[np.unique(w)].sum(axis=0) for w in windows])
    want = {(w, u): scores[w, u] for w, u in np.argwhere(scores >= index.needed)}
    got = {(w, u): s for w, u, s in zip(*(x.tolist() for x in index.retrieve(windows)))}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(np.isclose(got[k], want[k]) for k in got)


def test_weights_are_bm25():
    items = [d.Item.of(0, "a b b c"), d.Item.of(1, "a d"), d.Item.of(2, "e f g h i j")]
    index = d.Index(items)
    df = Counter(w for x in items for w in set(x.words))
    mean = np.mean([len(x.words) for x in items])
    t = index.term[b"b"]
    idf = np.log(1 + (3 - df[b"b"] + 0.5) / (df[b"b"] + 0.5))
    assert np.isclose(index.weights[index.run_start[index.term_start[t]]], idf * 2 * (d.K1 + 1) / (2 + d.K1 * (1 - d.B + d.B * 4 / mean)))


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(None, "a b c d e f g")], "item_id long, text string")
    docs = documents(["x a b c d e f g y", "clean"], ids=[None, 1])
    assert d.leaks(docs, none).count() == 0 and d.clean(docs, none).count() == 2
    assert [tuple(r)[:2] for r in d.leaks(docs, some).collect()] == [(None, None)] and d.clean(docs, some).count() == 1
    assert d.leaks(docs.limit(0), some).count() == 0
