import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tests.llm.conftest import CLASHES

SCHEMA = "doc_id long, text string, source string"


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing what is over, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = Fraction(sum(sizes.values())), set()
    while True:
        per = sum(weight[s] for s in names if s not in stopped)
        level = (total - sum(most * sizes[s] for s in stopped)) / (per or 1)
        target = {s: Fraction(most * sizes[s]) if s in stopped else weight[s] * level for s in names}
        over = {s for s in names if target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    own = defaultdict(int)
    for n, (_, _, s) in zip(size, rows):
        own[s] += n
    target, out = shares(own), []
    for n, (i, t, s) in zip(size, rows):
        rate = target[s] / own[s] if own[s] else Fraction(0)
        name = f"12:{i}" if i is not None else f"12-{t or ''}"
        drawn = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2.0**52
        whole = int(rate)
        out.append((i, n, own[s], float(target[s]), n * (whole + (drawn < float(rate - whole)))))
    return out


ROWS = [(i, "word " * (i % 7), f"s{i % 4}") for i in range(40)] + [
    (None, "a b", None), (None, None, None), (7, "", ""), (7, "x y z", ""), (-3, "one\x0btwo\tthree", "z"), (900, "long " * 50_000, "s0"), (901, None, "empty"), (902, " \n", "empty"),
    (903, "twice", "s1"), (903, "twice", "s1"), (904, "\U0001f600 b", "\U0001f600"), (905, "c", "￿"),
]


def test_equals_brute_force(spark):
    got = [tuple(r) for r in mixing.query(spark.createDataFrame(ROWS, SCHEMA).repartition(4)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(ROWS)))


def test_targets_add_up_and_none_is_passed(spark):
    rows = mixing.query(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert all(r.taken <= 3 * r.size for r in rows)
    target = shares({"a": 1000, "b": 1, "c": 10, "d": 0})
    assert target["b"] == 3 and target["d"] == 0 and sum(target.values()) == 1011


def test_many_sources_and_a_hot_one(spark):
    """Over a thousand sources, of which one has a third of all rows."""
    rows = [(i, "w " * (1 + i % 5), "hot" if i % 3 == 0 else f"s{i}") for i in range(4500)]
    got = [tuple(r) for r in mixing.query(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_a_source_comes_near_its_target(spark):
    rows = [(i, "w " * (20 + i % 50), f"s{i % 5}") for i in range(20_000)]
    got = mixing.query(spark.createDataFrame(rows, SCHEMA)).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.09 * r.target for r in got)  # four deviations


def test_documents_are_emitted_as_often_as_they_are_taken(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in (*CLASHES, "key", "copies", "target", "_copies")})
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    emitted = Counter(r.doc_id for r in out.collect())
    want = Counter()
    for i, n, _, _, taken in brute(ROWS):
        if n:
            want[i] += taken // n
    assert {i: emitted[i] for i in want if i not in (None, 7)} == {i: n for i, n in want.items() if i not in (None, 7)}


def test_an_empty_table(spark):
    assert mixing.query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_main_path_has_no_python_worker(spark):
    plan = mixing.query(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)


@pytest.mark.parametrize("weights,most", [((1,), 2), ((7, 3), 1), ((5, 2, 1), 50)])
def test_other_settings(spark, weights, most):
    rows = [(i, "w " * (i % 9), f"s{i % 6}") for i in range(300)]
    own = Counter()
    for _, t, s in rows:
        own[s] += len(t.split())
    sizes = spark.createDataFrame([(s, n) for s, n in own.items()], "source string, size long")
    got = {r.key[1:]: r.target for r in mixing.rates(sizes, weights, most).collect()}
    assert got == {s: float(x) for s, x in shares(own, weights, most).items()}
