import math
import random

import pytest
from pyspark.sql import functions as F

from tessera import model as m
from tessera.functions import text
from tessera.operators import search as s

SCHEMA = "chunk_id string, path string, start_line int, end_line int, language string, symbol_name string, text string"


def chunks(spark, rows):
    return s.with_tokens(spark.createDataFrame([(i, p, line, line + 1, "python", name, t) for i, p, line, name, t in rows], SCHEMA))


def ids(df):
    return [r.chunk_id for r in df.collect()]


def plain_tokens(value):
    out, run, prev = [], "", ""
    for i, c in enumerate(value):
        word = c.isalpha() or c.isdecimal()
        nxt = value[i + 1] if i + 1 < len(value) else ""
        cut = c.isupper() and (prev.islower() or prev.isdecimal() or (prev.isupper() and nxt.islower()))
        if run and (not word or cut):
            out.append(run.lower())
            run = ""
        if word:
            run += c
        prev = c if word else ""
    return [*out, run.lower()] if run else out


def test_tokens_equal_a_plain_reading(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcXYZ019_ .-éÉß") for _ in range(rng.randrange(0, 14))) for _ in range(500)] + ["HTTPServer2Go", "loadUserProfile", "a1B2", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.tokens(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: plain_tokens(t) for i, t in enumerate(texts)}


def test_lexical_scores_and_order(spark):
    c = chunks(spark, [
        ("best", "services/user.py", 1, "LoadUser", "def LoadUser():\n    return repository.find_user()"),
        ("partial", "services/load.py", 1, "Load", "def load():\n    pass"),
        ("unmatched", "services/health.py", 1, "Health", "def health():\n    return True"),
    ])
    rows = s.lexical_search(c, "load user", 10).collect()
    assert [r.chunk_id for r in rows] == ["best", "partial"]
    assert rows[0].score == pytest.approx(0.95) and rows[1].score == pytest.approx(0.5)
    plain = s.lexical_search(c.drop("text_tokens", "symbol_tokens", "path_tokens"), "load user", 10).collect()
    assert [(r.chunk_id, r.score) for r in plain] == [(r.chunk_id, r.score) for r in rows]


def test_the_fold_keeps_the_terms_order(spark):
    c = chunks(spark, [("x", "beta/one.py", 1, "beta", "beta"), ("y", "alpha/z.py", 1, "beta", "beta")])
    by = {r.chunk_id: r.score for r in s.lexical_search(c, "alpha beta", 9).collect()}
    assert by == {"x": (0.6 + 0.3 + 0.1) / 2, "y": (0.1 + 0.6 + 0.3) / 2}


def test_ties_filters_and_limits(spark):
    c = chunks(spark, [("b", "b.py", 1, "", "token"), ("late", "a.py", 8, "", "token"), ("first", "a.py", 2, "", "token")])
    assert ids(s.lexical_search(c, "token", 2)) == ["first", "late"]
    c = chunks(spark, [(p, p, 1, "", "search") for p in ("internal/search/searcher.py", "internalized/searcher.py", "pkg/search.py", "cmd/search.py")])
    wanted = m.Filter(path_prefixes=("internal/", "pkg"))
    assert ids(s.lexical_search(c, "search", 2, wanted)) == ["internal/search/searcher.py", "pkg/search.py"]
    assert ids(s.lexical_search(c, "search", 9, m.Filter(languages=("typescript",)), m.LANGUAGES)) == []
    for bad in (dict(text=""), dict(text=" "), dict(text="!!!"), dict(text="a", limit=0), dict(text="a", repository_id=" ")):
        with pytest.raises(m.InvalidQuery):
            s.lexical_search(c, **bad)
    for bad in (m.Filter(path_prefixes=("../x",)), m.Filter(path_prefixes=("a//",)), m.Filter(path_prefixes=("",)), m.Filter(languages=("go",))):
        with pytest.raises(m.InvalidFilter):
            s.lexical_search(c, "a", 1, bad, m.LANGUAGES)


def test_top_k_plan(spark):
    c = chunks(spark, [("b", "b.py", 1, "", "token")])
    plan = s.lexical_search(c, "token", 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def vectors(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, values array<float>")


def test_vectors(spark):
    c = chunks(spark, [("negative", "pkg/negative.py", 5, "", "x"), ("zero", "pkg/zero.py", 3, "", "x"), ("positive", "pkg/positive.py", 1, "", "x")])
    v = vectors(spark, [("negative", [-1.0, 0.0]), ("zero", [0.0, 8.0]), ("positive", [3.0, 0.0])])
    q = s.normalize_query([9.0, 0.0], 2)
    rows = s.vector_candidates(c, v, q, 3).orderBy(F.desc("similarity")).collect()
    assert [(r.chunk_id, round(r.similarity, 7)) for r in rows] == [("positive", 1), ("zero", 0), ("negative", -1)]
    assert [(r.chunk_id, r.score) for r in s.vector_search(c, v, q, 2).collect()] == [("positive", 1.0), ("zero", 0.5)]
    unit = v.select(s.normalized(F.col("values")).alias("u")).collect()
    assert sorted(tuple(r.u) for r in unit) == [(-1.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
    bad = vectors(spark, [("a", [0.0, 0.0]), ("b", [float("nan"), 1.0]), ("c", [float("inf"), 1.0])]).select(s.normalized(F.col("values")).alias("u"), s.rescaled(F.col("values")).alias("w")).collect()
    assert all(r.u is None and r.w is None for r in bad)
    huge = spark.createDataFrame([([3e200, 4e200],)], "v array<double>").select(s.rescaled(F.col("v")).alias("u")).first().u
    assert huge == pytest.approx([0.6, 0.8])
    for q in ([], [0.0, 0.0], [math.nan, 1.0], [1.0]):
        with pytest.raises(m.InvalidQueryVector):
            s.normalize_query(q, 2)


def ranked(spark, names):
    return spark.createDataFrame([(n, "x.py", 1, 2, 900.0 - 7 * i) for i, n in enumerate(names)], "chunk_id string, path string, start_line int, end_line int, score double")


def test_fusion(spark):
    rows = s.fuse(ranked(spark, "abc"), ranked(spark, "cbd"), 4).collect()
    assert [r.chunk_id for r in rows] == list("cbad")
    assert [r.score for r in rows] == pytest.approx([0.9841269841269841, 0.9838709677419355, 0.5, 0.48412698412698413], abs=1e-12)
    tie = s.fuse(ranked(spark, "ab"), ranked(spark, "cd"), 9, k=1, lexical_weight=1, vector_weight=1).collect()
    assert [r.chunk_id for r in tie] == list("acbd")
    assert [s.candidate_window(x) for x in (1, 5, 6, 50, 51, 200)] == [20, 20, 24, 200, 200, 200]
    for limit in (0, 201):
        with pytest.raises(m.InvalidQuery):
            s.candidate_window(limit)
    for bad in (dict(k=-1), dict(lexical_weight=math.inf), dict(vector_weight=-2), dict(k=1e308, lexical_weight=1e-300)):
        with pytest.raises(m.InvalidConfig):
            s.fusion_settings(**bad)
    other = ranked(spark, "a").withColumn("path", F.lit("other.py"))
    with pytest.raises(m.EvidenceIntegrity):
        s.fuse(ranked(spark, "a"), other, 4, check=True)


def test_batches_give_the_same_doubles(spark):
    rng = random.Random(7)
    n = 300
    q = s.normalize_query([rng.uniform(-1, 1) for _ in range(n)])
    rows = [(i, [rng.uniform(-1, 1) for _ in range(n)]) for i in range(40)] + [(90, q), (91, [0.0] * n), (92, None), (93, [1.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    literal = F.array(*(F.lit(x).cast("float") for x in q))
    got = df.select("i", s.cosine(F.col("v"), literal).alias("a"), s.cosine_batches(F.col("v"), q).alias("b")).collect()
    assert all(r.a == r.b for r in got if r.i <= 90) and all(r.b is None for r in got if r.i > 90)
    assert [r.a for r in got if r.i == 91] == [None]
