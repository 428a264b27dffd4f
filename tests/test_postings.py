import random

import pytest
from pyspark.sql import functions as F

from tessera import model as m
from tessera.operators import postings as p
from tessera.operators import search as s

SCHEMA = "chunk_id string, path string, start_line int, end_line int, language string, symbol_name string, text string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """2,000 chunks: one word on nearly all, others on ever fewer."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(2000):
        text = ["common"] * (i % 50 > 0) + [w for k, w in enumerate(words) if rng.random() < 0.5 ** (k / 4 + 1)]
        rows.append((f"c{i:04}", f"{rng.choice(['src', 'lib'])}/{rng.choice(words[:6])}_{i % 90}.py", rng.randrange(1, 5), 9, rng.choice(["python", "typescript"]), rng.choice(["", *words[:9], "common"]), " ".join(text) or "x"))
    chunks = s.with_tokens(spark.createDataFrame(rows, SCHEMA))
    folder = str(tmp_path_factory.mktemp("postings"))
    chunks.write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    p.postings(chunks, 6).write.option("parquet.block.size", 4096).option("parquet.page.row.count.limit", 100).parquet(f"{folder}/postings")
    return chunks, spark.read.parquet(f"{folder}/postings")


QUERIES = ["common", "w30", "common w30", "w39 common w0 w25", "w12 w13", "src common", "nothing common", "nothing", "w0 w1 w2 w3 common lib", "w38 w39", "common w20 w21 w22", " ".join(f"w{i}" for i in range(30))]


@pytest.mark.parametrize("limit", [1, 10, 150, 250])
def test_the_rows_are_those_of_the_scan(table, limit):
    chunks, inverted = table
    for text in QUERIES:
        for wanted in (m.Filter(), m.Filter(path_prefixes=("src",), languages=("python",))) if limit == 10 else (m.Filter(),):
            want = [(r.chunk_id, r.score) for r in s.lexical_search(chunks, text, limit, wanted).collect()]
            assert [(r.chunk_id, r.score) for r in p.search(chunks, inverted, text, limit, wanted).collect()] == want, text


def test_short_lists_settle_some_queries(table, monkeypatch):
    chunks, inverted = table
    settled = {}
    monkeypatch.setattr(p, "_by_short", lambda *a, f=p._by_short: settled.setdefault(a[2][0], f(*a)))
    for text in QUERIES:
        p.search(chunks, inverted, text, 1)
    assert sum(x is not None for x in settled.values()) >= 2 and any(x is None for x in settled.values())


def scanned(df):
    """Rows that the files' readers gave."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    todo, n = [node], 0
    while todo:
        x = todo.pop()
        if x.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(x.executedPlan())
        elif x.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(x.plan())
        if x.getClass().getSimpleName() == "FileSourceScanExec":
            n += x.metrics().apply("numOutputRows").value()
        todo += [x.children().apply(i) for i in range(x.children().size())]
    return n


def test_rare_terms_read_little(table):
    _, inverted = table
    every = scanned(inverted.select("token", "field", "chunk_id"))
    rows = lambda term: scanned(inverted.where(p._of([(term, 0)])).select("chunk_id"))
    assert every == inverted.count() and rows("w35") < every / 10 and rows("w35") < rows("common") / 4


def test_refused_queries(table):
    for bad in (dict(text=""), dict(text="!!"), dict(text="a", limit=0), dict(text="a", repository_id=" ")):
        with pytest.raises(m.InvalidQuery):
            p.search(*table, **bad)
    with pytest.raises(m.InvalidFilter):
        p.search(*table, "a", 1, m.Filter(path_prefixes=("../x",)))


def test_an_empty_table(table):
    chunks, inverted = table
    assert p.search(chunks, inverted.where(F.lit(False)), "common", 5).collect() == []
