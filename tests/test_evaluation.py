import json
import math
import os

import pytest

from tessera import model as m
from tessera.operators import evaluate as e
from tessera.operators import goldset as g
from tessera.plans import evaluation as ev


def frames(spark, cases, hits, qrels):
    return (spark.createDataFrame(cases, "case_id string, category string"), spark.createDataFrame(hits, "case_id string, rank int, chunk_id string"), spark.createDataFrame(qrels, "case_id string, chunk_id string, relevance int"))


def test_metrics(spark):
    c = frames(spark, [("p", "concept"), ("q", "concept"), ("z", "framework")], [("p", 1, "b"), ("p", 2, "x"), ("p", 3, "a"), ("q", 1, "low"), ("q", 2, "high")], [("p", "a", 1), ("p", "b", 1), ("q", "high", 3), ("q", "low", 1), ("z", "n", 2)])
    by = {r.case_id: r for r in e.case_metrics(*c).collect()}
    assert (by["p"].recall_5, by["p"].recall_10, by["p"].mrr_10) == (1, 1, 1) and by["p"].ndcg_10 == pytest.approx(1.5 / (1 + 1 / math.log2(3)), abs=1e-12)
    assert by["q"].ndcg_10 == pytest.approx((1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)), abs=1e-12)
    assert (by["z"].recall_10, by["z"].mrr_10, by["z"].ndcg_10) == (0, 0, 0)
    runs = spark.createDataFrame([(0, 0), (0, 1)], "n_first int, n_second int")
    assert runs.agg(e.no_evidence_accuracy(runs)).first()[0] == 0.5
    us = spark.createDataFrame([(100,), (300,)], "us long").agg(*e.latency_percentiles("us")).first()
    assert (us.p50, us.p95) == (100, 300)
    _, hits, _ = c
    assert e.determinism(hits, hits).first().rate == 1 and e.determinism(hits, hits.withColumn("rank", -hits.rank)).first().rate == 0


def gold(**change):
    case = lambda i: {"id": f"case-{i:02}", "category": "concept", "query": f"load thing {i}", "expectation": "relevant", "judgments": [{"reference": {"path": "src/a.py", "start_line": 1, "end_line": 2}, "relevance": 3}]}
    return {"schema": 1, "repository": "repo-ab", "scan_policy_version": "scanner-v6", "cases": [case(i) for i in range(5)]} | change


def test_gold_sets():
    parsed = g.parse_gold_set(json.dumps(gold()).encode(), "repo-ab")
    assert len(parsed.cases) == len(parsed.judgments) == 5
    bad = [gold(schema=2), gold(repository="repo-cd"), gold(scan_policy_version="v5"), gold(cases=[]), gold(cases=gold()["cases"][:4]), gold(extra=1), gold(schema=True)]
    for change in (dict(id="x"), dict(category="else"), dict(query=" "), dict(expectation="no_evidence"), dict(judgments=[]), dict(judgments=gold()["cases"][0]["judgments"] * 2), dict(id="case-01"), dict(query="load thing 1")):
        cases = gold()["cases"]
        bad.append(gold(cases=[cases[0] | change, *cases[1:]]))
    for change in (dict(relevance=4), dict(reference={"path": "/a", "start_line": 1, "end_line": 2}), dict(reference={"path": "a", "start_line": 2, "end_line": 1})):
        cases = gold()["cases"]
        bad.append(gold(cases=[cases[0] | {"judgments": [cases[0]["judgments"][0] | change]}, *cases[1:]]))
    for value in bad:
        with pytest.raises(m.GoldSetError):
            g.parse_gold_set(json.dumps(value).encode(), "repo-ab")
    for raw in (b"", b"{", b"\xff", json.dumps(gold()).encode() + b"{}", json.dumps(gold()).replace('"schema": 1', '"schema": 1, "schema": 1').encode(), b"[" * 50 + b"]" * 50):
        with pytest.raises(m.GoldSetError) as error:
            g.parse_gold_set(raw, "repo-ab")
        assert "load" not in str(error.value)


def checklist(**change):
    return {**dict.fromkeys(g.GATES, True), "budgets": dict(max_duration_milliseconds=60000, max_eligible_bytes=10**6, max_eligible_files=100, max_output_bytes=10**6, max_auto_queries=5)} | change


def test_checklists():
    parse = lambda v: g.parse_checklist(json.dumps(v).encode())
    assert parse(checklist()).blockers == 0 and parse(checklist(owner_authorized=False)).blockers == 1
    assert parse(checklist(budgets=checklist()["budgets"] | {"max_auto_queries": 0})).blockers == 1
    for bad in (checklist(owner_authorized=1), checklist(more=True), {}):
        with pytest.raises(m.GoldSetError):
            parse(bad)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("def load():\n    return 1\n\nclass Thing:\n    pass\n")
    (root / "src/config.ts").write_text("42\n")
    (root / "README.md").write_text("secret words")
    return str(root)


def test_a_whole_evaluation(spark, tree, tmp_path):
    checks = g.parse_checklist(json.dumps(checklist()).encode())
    report = ev.evaluate_tree(spark, tree, "repo-ab", checks)
    assert report["decision"] == "go" and ev.valid_report(report)
    i = report["inventory"]
    assert (i["included_files"], i["chunks"], i["files_without_symbols"], i["symbol_kinds"], i["pattern_buckets"], i["unsupported_extensions"]) == (2, 3, 1, {"function": 1, "class": 1}, {"permitted_configuration": 1}, {".md": {"files": 1, "bytes": 12}})
    r = report["retrieval"]
    assert r["categories"]["exact_symbol"]["recall_at_5"] == 1 and r["citation_validity"] == r["deterministic_order_rate"] == 1
    parsed = g.parse_gold_set(json.dumps(gold()).encode(), "repo-ab")
    with_gold = ev.evaluate_tree(spark, tree, "repo-ab", checks, parsed)
    assert with_gold["retrieval"]["categories"].keys() == {"concept"} and with_gold["decision"] == "go"
    wrong = gold()
    wrong["cases"][0]["judgments"][0]["reference"]["end_line"] = 9
    assert ev.evaluate_tree(spark, tree, "repo-ab", checks, g.parse_gold_set(json.dumps(wrong).encode(), "repo-ab"))["blockers"] == {"gold_set": 1}
    assert ev.evaluate_tree(spark, tree, "repo-ab", g.parse_checklist(json.dumps(checklist(owner_authorized=False)).encode()))["blockers"] == {"checklist": 1}
    assert ev.evaluate_tree(spark, tree + "x", "repo-ab", checks)["blockers"] == {"scan": 1}
    tight = checklist(budgets=checklist()["budgets"] | {"max_eligible_files": 1})
    assert ev.evaluate_tree(spark, tree, "repo-ab", g.parse_checklist(json.dumps(tight).encode()))["blockers"] == {"budget": 1}
    for change in (dict(decision="no-go"), dict(more=1), dict(repository="x"), dict(blockers={"scan": 1})):
        with pytest.raises(m.EvaluationError):
            ev.marshal(report | change)
    data = ev.marshal(report)
    assert b"load" not in data.replace(b"peak", b"") and b"src/" not in data and b"secret words" not in data
    out = tmp_path / "out"
    out.mkdir(mode=0o700)
    ev.publish_report(str(out / "r.json"), data, tree)
    assert json.loads((out / "r.json").read_bytes())["decision"] == "go" and (out / "r.json").stat().st_mode & 0o777 == 0o600 and os.listdir(out) == ["r.json"]
    for path in (str(out / "r.json"), "r.json", os.path.join(tree, "r.json"), str(tmp_path / "none/r.json")):
        with pytest.raises(m.EvaluationError):
            ev.publish_report(path, data, tree)


def test_aggregates(spark):
    from pyspark.sql import functions as F

    sizes = spark.createDataFrame([(4096,), (4097,), (16384,), (65537,), (262145,)], "n int").select(e.size_band(F.col("n")).alias("b"))
    assert [r.b for r in sizes.collect()] == ["0-4KiB", "4-16KiB", "4-16KiB", "64-256KiB", "256KiB-1MiB"]
    paths = ["Tests/a.py", "a_test.py", "x.spec.ts", "db/migration/config.py", "app.config.ts", "contest/x.py", "test_a/b.py", "configure.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", e.path_patterns(F.col("p")).alias("b")).collect()
    assert {r.p: r.b for r in got} == {"Tests/a.py": ["test"], "a_test.py": ["test"], "x.spec.ts": ["test"], "db/migration/config.py": ["migration", "permitted_configuration"], "app.config.ts": ["permitted_configuration"], "contest/x.py": [], "test_a/b.py": [], "configure.py": []}


def source_chunks(spark, n=300):
    import random

    from tessera.operators.search import with_tokens

    rng = random.Random(4)
    words = ["load", "user", "Thing", "loadUser", "cache", "x", "HTTPServer", "store_row", "été"]
    rows = [(f"c{i:03}", " ".join(rng.choices(words, k=rng.randrange(1, 9))), "python", rng.choice(["", *words[:5]]), f"{rng.choice(words)}/{rng.choice(words)}{i % 50}.py", rng.randrange(1, 4), 9) for i in range(n)]
    return with_tokens(spark.createDataFrame(rows, "chunk_id string, text string, language string, symbol_name string, path string, start_line int, end_line int"))


def jobs(spark, run):
    """How many jobs a call starts."""
    import uuid

    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_many_queries_in_one_plan_give_the_same_hits(spark, monkeypatch):
    from tessera.operators import search
    from tessera.operators.search import lexical_batch, lexical_search

    chunks = source_chunks(spark).cache()
    long = " ".join(f"word{i}" for i in range(45))  # marks of three words, and more than three longs of terms
    queries = ["load", "user load", "HTTPServer cache x load", "loadUser loadUser", "nothing", f"{long} user {long} load été", "py x1"]
    cases = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "case_id string, query string")
    found = lexical_batch(chunks, cases, 7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert plan.count("WindowGroupLimit") == 2 and dealt == ["case_id", "chunk_id"]  # the best of a case, and chunks: no match
    monkeypatch.setattr(search, "BATCH_BYTES", 0)
    many = lexical_batch(chunks, cases, 7)
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString() and sorted(many.collect()) == sorted(found.collect())
    got = sorted((r.case_id, r["rank"], r.chunk_id, r.score) for r in found.collect())
    want = [(f"q{i}", k, r.chunk_id, r.score) for i, q in enumerate(queries) for k, r in enumerate(lexical_search(chunks, q, 7).collect(), 1)]
    assert got == want and len(want) > 30
    with pytest.raises(m.InvalidQuery):
        lexical_batch(chunks, spark.createDataFrame([("a", "x"), ("b", "!!")], "case_id string, query string"))
    assert lexical_batch(chunks, cases.limit(0)).collect() == [] and lexical_batch(chunks.limit(0), cases).collect() == []


def test_a_task_merges_a_bounded_number_of_pairs(spark, monkeypatch):
    """However many chunks and cases there are; were the tasks' number fixed, what each holds would grow with the chunks."""
    import re

    from tessera.operators import search

    chunks = source_chunks(spark).cache()
    cases = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(["load", "user load", "cache x load", "x1", "py"])], "case_id string, query string")
    dealt = lambda df: int(re.search(r"hashpartitioning\(chunk_id#\d+, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()).group(1))
    usual = search.lexical_batch(chunks, cases, 7)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(usual) == parts
    monkeypatch.setattr(search, "BATCH_PAIRS", 3)
    found, n = search.lexical_batch(chunks, cases, 7), chunks.count() * 5
    assert dealt(found) == -(-n // 3) > parts and sorted(found.collect()) == sorted(usual.collect())


def test_a_task_merges_a_bounded_number_of_matches_of_joined_terms(spark, monkeypatch):
    """So many queries that their terms aren't broadcast: the merge's tasks grow with what is found."""
    import re

    from tessera.operators import search

    chunks = source_chunks(spark).cache()
    queries = ["load", "user load", "cache x load", "x1", "py"]
    cases = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "case_id string, query string")
    usual = sorted(search.lexical_batch(chunks, cases, 7).collect())
    rows = chunks.select("text_tokens", "symbol_tokens", "path_tokens").collect()
    n = sum(t in field for q in queries for t in search.query_terms(spark, q) for r in rows for field in r)
    monkeypatch.setattr(search, "BATCH_BYTES", 0)
    monkeypatch.setattr(search, "BATCH_MATCHES", 10)
    found = search.lexical_batch(chunks, cases, 7)
    dealt = re.findall(r"hashpartitioning\(([^)]*), (\d+)\)", re.sub(r"#\d+", "", found._jdf.queryExecution().executedPlan().toString()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ("case_id, chunk_id", str(-(-n // 10))) in dealt and n > 10 * parts and sorted(found.collect()) == usual
    assert not [by for by, _ in dealt if "n_terms" in by]  # merged where they were dealt
    assert search.lexical_batch(chunks, cases.where("case_id = 'q3'"), 7).count() == search.lexical_batch(chunks.limit(0), cases, 7).count() == 0


def test_measures_do_not_depend_on_how_many_pairs_a_task_merges(spark, monkeypatch):
    from tessera.operators import search

    chunks = source_chunks(spark).cache()
    cases, qrels = ev.automatic_cases(chunks, 50)
    usual = [df.collect() for df in ev.measured(chunks, cases, qrels)]
    monkeypatch.setattr(search, "BATCH_PAIRS", 3)
    assert [df.collect() for df in ev.measured(chunks, cases, qrels)] == usual and usual[1][0]["hits"] > 0


def test_the_number_of_jobs_does_not_depend_on_the_cases(spark, monkeypatch):
    monkeypatch.setattr(ev, "TIMED_CASES", 1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that a query is a job
    try:
        chunks = source_chunks(spark).cache()
        chunks.count()
        seen = []
        for limit in (2, 5):
            cases, qrels = ev.automatic_cases(chunks, limit)
            (report, latency), n = jobs(spark, lambda: ev.metrics(chunks, cases, qrels))  # noqa: B023
            seen.append(n)
            assert report["categories"]["exact_symbol"]["query_count"] == limit and report["citation_validity"] == report["deterministic_order_rate"] == 1
        assert max(seen) < 30 and abs(seen[0] - seen[1]) < 3  # a limit may take another look
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_name_on_every_chunk_makes_no_list(spark):
    chunks = source_chunks(spark)
    from pyspark.sql import functions as F

    hot = chunks.withColumn("symbol_name", F.lit("Hot"))
    cases = e.exact_symbol_cases(hot, 10)
    assert [tuple(r) for r in cases.collect()] == [("Hot", "c000")]
    flat = e.symbol_chunks(hot, cases)
    assert flat.count() == 300 and "collect_list" not in flat._jdf.queryExecution().executedPlan().toString()


def test_an_inventory_is_one_job(spark):
    files = spark.createDataFrame([("a/x.py", "python", 10), ("a/y.py", "python", 5000), ("tests/z.ts", "typescript", 3), ("e.js", "javascript", 0)], "path string, language string, size int")
    chunks = spark.createDataFrame([("a/x.py", "class", "abc"), ("a/x.py", "function", "é"), ("a/y.py", "", "text"), ("tests/z.ts", "namespace", "zz")], "path string, kind string, text string")
    rows = {(r.dimension, r.value): (r.n, r.bytes) for r in e.inventory(files, chunks).collect()}
    assert rows == {
        ("files", ""): (4, 5013), ("extension", ".py"): (2, 5010), ("extension", ".ts"): (1, 3), ("extension", ".js"): (1, 0), ("language", "python"): (2, 5010), ("language", "typescript"): (1, 3), ("language", "javascript"): (1, 0),
        ("size_band", "0-4KiB"): (3, 13), ("size_band", "4-16KiB"): (1, 5000), ("pattern", "test"): (1, 3), ("chunks", ""): (4, 11), ("kind", "class"): (1, 0), ("kind", "function"): (1, 0), ("kind", "other"): (1, 0), ("files_without_symbols", ""): (2, 0),
    }
    empty = {r.dimension: r.n for r in e.inventory(files.limit(0), chunks.limit(0)).collect()}
    assert empty == {"files_without_symbols": 0}
