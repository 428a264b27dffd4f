import math

import numpy as np
import pytest

from tessera.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, vectors, least=0.9):
    n = len(ids)

    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def link(a, b):
        if not (ok(a) and ok(b)) or len(a) != len(b):
            return False
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return float(e.cosines(a[None], b[None])[0]) >= least

    near = [[i != j and link(vectors[i], vectors[j]) for j in range(n)] for i in range(n)]
    part = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if near[i][j]:
                    part[i] = part[j] = min(part[i], part[j])
    out = []
    for i in range(n):
        reach = [ids[j] for j in range(n) if part[j] == part[i] and ids[j] is not None]
        out.append((ids[i], sum(near[i]), min(reach, default=None)))
    return out


def made(seed=0, n=70, dims=12):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((9, dims))
    vectors = [(base[rng.integers(9)] * rng.uniform(0.1, 9) + rng.standard_normal(dims) * rng.choice([0, 0.2, 0.35])).astype(np.float32).tolist() for _ in range(n)]
    vectors += [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [float("inf")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0, 2.0], [2.0, 4.0], [1e30] * dims, [2e30] * dims]
    vectors += [vectors[0]] * 3
    ids = [int(x) for x in rng.permutation(len(vectors))]
    ids[4], ids[5], ids[7] = None, ids[6], None
    return ids, vectors


@pytest.mark.parametrize("strip,leaf,fan", [(8192, 1024, 16), (8, 5, 2)])
def test_equals_brute_force(spark, monkeypatch, strip, leaf, fan):
    monkeypatch.setattr(e, "STRIP", strip)
    monkeypatch.setattr(e, "LEAF", leaf)
    monkeypatch.setattr(e, "_FAN", fan)
    if strip < 100:
        monkeypatch.setattr(e, "GROUP_BYTES", 1)
    ids, vectors = made(n=70 if strip > 100 else 40)
    df = spark.createDataFrame([(i, v, 0) for i, v in zip(ids, vectors)], SCHEMA).repartition(3)
    rows = e.query(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows if r.vec_id is not None)
    got = [(r.vec_id, r.n_links, r.component_id) for r in rows]
    assert sorted(got, key=repr) == sorted(brute(ids, vectors), key=repr)


def test_components_of_any_size_are_scaled(spark):
    vectors = [[1e-200, 2e-200], [1e200, 2e200], [2.0, 4.0], [5e-324, 0.0], [1.0, 0.0], [-1.0, 0.0], [1e308, -1e308]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_vectors(df).collect())
    assert got == [(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True)]


def test_pairs_of_groups_are_those_not_apart(spark):
    rng = np.random.default_rng(3)
    lo = np.sort(rng.uniform(0, 9, (41, 2)), axis=0)
    boxes = [(g, x.tolist(), (x + 0.4).tolist()) for g, x in enumerate(lo)]
    got = {(r.p, r.q) for r in e.near_pairs(spark.createDataFrame(boxes, "grp long, lo array<double>, hi array<double>"), 2, 41, 0.3).collect()}
    assert got == {(i, j) for i in range(41) for j in range(i, 41) if (lo[j] - lo[i] - 0.4 <= 0.3).all() and (lo[i] - lo[j] - 0.4 <= 0.3).all()}


def test_strips_and_leaves_find_all_links():
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((12, 8))[rng.integers(0, 12, 400)] + rng.standard_normal((400, 8)) * 0.3).astype(np.float32)
    directions, eps = e.principal(x.astype(float), 3), math.sqrt(0.2) + 1e-9
    unit = e._unit(x.astype(float))
    order = np.lexsort(np.floor(unit @ directions / eps).T[::-1])
    x, unit = x[order], unit[order]
    want = (unit @ unit.T >= 0.9) & ~np.eye(400, dtype=bool)
    strips = [e.Strip(x[c : c + 40], np.ones(40, np.int64), directions) for c in range(0, 400, 40)]
    pairs = [(i, j) for i in range(10) for j in range(i, 10) if not e._apart(strips[i].lo, strips[i].hi, strips[j].lo, strips[j].hi, eps)]
    assert len(pairs) < 55, "nothing was skipped"
    for i, j in pairs:
        e.join_strips(strips[i], strips[j], eps, 0.9, 7)
    assert (np.concatenate([s.links for s in strips]) == want.sum(axis=1)).all()


def test_empty_table(spark):
    assert e.query(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in e.query(spark.createDataFrame([(3, None, 1)], SCHEMA)).collect()] == [(3, 0, 3, True)]
