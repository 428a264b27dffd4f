"""The offline evaluation of lexical retrieval over a tree, with a report of aggregates only."""

from __future__ import annotations

import json
import os
import re
import resource
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model as m
from tessera.operators import evaluate as e
from tessera.operators import goldset as g
from tessera.operators.declarations import chunk_files
from tessera.operators.search import lexical_batch, lexical_search, with_tokens
from tessera.session import stored
from tessera.sources.tree import scan

SCHEMA = 2
BLOCKERS = ("checklist", "gold_set", "root", "location", "budget", "scan", "integrity", "retrieval", "canceled")
KINDS = e.KINDS
MAX_REPORT_BYTES = 16 << 20
LIMIT = 10
_METRICS = ("recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_10")


def empty_report(repository: str) -> dict:
    """Complete, and a no-go until an evaluation fills it."""
    inventory = dict.fromkeys(("eligible_files", "eligible_bytes", "included_files", "included_bytes", "files_without_symbols", "chunks", "indexed_bytes"), 0)
    inventory |= {k: {} for k in ("excluded_by_category", "supported_languages", "supported_extensions", "unsupported_extensions", "size_bands", "symbol_kinds", "pattern_buckets")}
    return {
        "schema": SCHEMA, "repository": repository, "decision": "no-go", "blockers": {}, "inventory": inventory,
        "retrieval": {"status": "not-evaluated", "categories": {}, "citation_validity": 0.0, "deterministic_order_rate": 0.0, "fallback_count": 0, "fallback_reason": "zero"},
        "performance": dict.fromkeys(("scan_milliseconds", "index_milliseconds", "query_p50_microseconds", "query_p95_microseconds", "peak_heap_bytes_approximate"), 0),
        "capability_gaps": {c: "not-evaluated" for c in g.CATEGORIES}, "limitations": {"heap_peak_approximate": 1, "process_local_latency": 1, "frameworks_not_inferred": 1},
    }


def blocked(report: dict, category: str) -> dict:
    if category not in BLOCKERS:
        raise m.EvaluationError("integrity")
    return report | {"decision": "no-go", "blockers": {category: 1}}


_HIT = ("chunk_id", "path", "start_line", "end_line", "language", "symbol_name", "text")
#: So many cases, the first by id, are run one by one besides, to see how long one query takes.
TIMED_CASES = 20


def hits_of(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, rank, ..): the ranked hits of all cases with the columns that a citation states, stored."""
    found = lexical_batch(chunks, cases.select("case_id", "query"), LIMIT).drop("score")
    return stored(found.join(chunks.select(*_HIT), "chunk_id").select("case_id", "rank", *_HIT), "hits")


def latencies(chunks: DataFrame, cases: DataFrame) -> list[int]:
    """Microseconds of single queries."""
    micros = []
    for case in cases.orderBy("case_id").limit(TIMED_CASES).collect():
        began = time.perf_counter()
        lexical_search(chunks, case["query"], LIMIT).select(*_HIT).collect()
        micros.append(int((time.perf_counter() - began) * 1e6))
    return micros


def measured(chunks: DataFrame, cases: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per category, overall) metrics. All cases are run as one plan, twice, and nothing is kept between the runs.

    Per category: cases, recall_5, recall_10, mrr_10, ndcg_10. Overall, one row: cases, hits, validity, same (cases with equal order in
    both runs), no_evidence (cases), accuracy.
    """
    first, second = hits_of(chunks, cases), hits_of(chunks, cases)
    relevant = cases.where("expectation = 'relevant'").select("case_id", "category")
    by = e.category_metrics(e.case_metrics(relevant, first, qrels))
    n = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    none = cases.where("expectation = 'no_evidence'").join(n(first, "n_first"), "case_id", "left").join(n(second, "n_second"), "case_id", "left").fillna(0, ["n_first", "n_second"])
    none = none.agg(F.count("*").alias("no_evidence"), e.no_evidence_accuracy(none).alias("accuracy"))
    order = e.determinism(first, second).select(F.col("cases").alias("with_hits"), "same")  # cases without a hit in both runs are alike
    total = cases.agg(F.count("*").alias("cases"))
    overall = total.crossJoin(order).crossJoin(none).crossJoin(e.citation_validity(first.union(second), chunks))
    return by, overall.select("cases", "hits", "validity", (F.col("same") + F.col("cases") - F.col("with_hits")).alias("same"), "no_evidence", "accuracy")


def metrics(chunks: DataFrame, cases: DataFrame, qrels: DataFrame) -> tuple[dict, dict]:
    """The report's retrieval and latency parts."""
    cases = stored(cases, "cases")
    by, overall = measured(chunks, cases, qrels)
    total = overall.first()
    if not total["cases"]:
        raise m.MetricsError("no cases")
    categories = {r["category"]: {"status": "evaluated", "query_count": r["cases"], **dict(zip(_METRICS, (r["recall_5"], r["recall_10"], r["mrr_10"], r["ndcg_10"]))), "no_evidence_accuracy": 0.0} for r in by.collect()}
    if total["no_evidence"]:
        categories["negative_evidence"] = {"status": "evaluated", "query_count": total["no_evidence"], **dict.fromkeys(_METRICS, 0.0), "no_evidence_accuracy": total["accuracy"]}
    micros = chunks.sparkSession.createDataFrame([(x,) for x in latencies(chunks, cases)], "us long")
    p50, p95 = micros.agg(*e.latency_percentiles("us")).first()
    retrieval = {"status": "evaluated", "categories": categories, "citation_validity": total["validity"], "deterministic_order_rate": total["same"] / total["cases"], "fallback_count": 0, "fallback_reason": "lexical_baseline"}
    return retrieval, {"query_p50_microseconds": int(p50), "query_p95_microseconds": int(p95)}


def automatic_cases(chunks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(cases, qrels): one case for each of the first symbol names; all chunks of a name are relevant."""
    named = e.exact_symbol_cases(chunks, limit)
    case_id = F.concat(F.lit("case-"), F.substring(F.sha2("query", 256), 1, 16))
    cases = stored(named.select(case_id.alias("case_id"), F.lit("exact_symbol").alias("category"), "query", F.lit("relevant").alias("expectation")), "cases")
    return cases, stored(e.symbol_chunks(chunks, cases).select(case_id.alias("case_id"), "chunk_id", F.lit(1).alias("relevance")), "qrels")


def inventory_of(files: DataFrame, chunks: DataFrame) -> dict:
    """The report's counts, by one job."""
    by: dict[str, dict] = {}
    for r in e.inventory(files.select("path", "language", F.octet_length("content").alias("size")), chunks).collect():
        by.setdefault(r["dimension"], {})[r["value"]] = (r["n"], r["bytes"])
    counts = lambda name: {k: n for k, (n, _) in by.get(name, {}).items()}
    n, size = by.get("chunks", {}).get("", (0, 0))
    return {"supported_extensions": counts("extension"), "symbol_kinds": counts("kind"), "files_without_symbols": by["files_without_symbols"][""][0], "pattern_buckets": counts("pattern"), "chunks": n, "indexed_bytes": size}


def evaluate_tree(spark: SparkSession, root: str, repository: str, checklist: g.Checklist, gold: g.GoldSet | None = None) -> dict:
    """A complete report. Any failure is a no-go with one category, and no other word about it."""
    if not g.valid_repository(repository):
        raise m.EvaluationError("checklist")
    report = empty_report(repository)
    if checklist.blockers:
        return blocked(report, "checklist")
    step = "scan"
    try:
        began = time.perf_counter()
        files, found, policy = scan(spark, root)
        report["performance"]["scan_milliseconds"] = int((time.perf_counter() - began) * 1000)
        if found.eligible_files > checklist.budgets["max_eligible_files"] or found.eligible_bytes > checklist.budgets["max_eligible_bytes"]:
            return blocked(report, "budget")
        step, began = "integrity", time.perf_counter()
        files = stored(files, "files")
        chunks = stored(with_tokens(chunk_files(files)), "chunks")
        report["inventory"] |= inventory_of(files, chunks)
        report["performance"]["index_milliseconds"] = int((time.perf_counter() - began) * 1000)
        report["inventory"] |= {
            "eligible_files": found.eligible_files, "eligible_bytes": found.eligible_bytes, "included_files": found.included_files, "included_bytes": found.included_bytes,
            "excluded_by_category": dict(found.excluded), "supported_languages": dict(found.by_language), "size_bands": dict(found.size_bands),
            "unsupported_extensions": {x: {"files": c, "bytes": found.unsupported_bytes[x]} for x, c in found.unsupported_files.items()},
        }
        step = "gold_set" if gold else "retrieval"
        if gold:
            cases, qrels = g.resolved(gold, chunks)
        else:
            cases, qrels = automatic_cases(chunks, min(g.MAX_CASES, checklist.budgets["max_auto_queries"]))
            report["limitations"]["automatic_exact_symbol_only"] = 1
        step = "retrieval"
        if cases.limit(1).count():
            retrieval, latency = metrics(chunks, cases, qrels)
            report["retrieval"] = retrieval
            report["performance"] |= latency
            report["capability_gaps"] = {c: "evaluated" if c in retrieval["categories"] else "not-evaluated" for c in g.CATEGORIES}
        report["performance"]["peak_heap_bytes_approximate"] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
        report["decision"] = "go"
        return report
    except m.EngineError:
        return blocked(report, step)


# --- the report ----------------------------------------------------------------------------------


def valid_report(report: dict) -> bool:
    """Only known keys, sums that agree, and a go if and only if nothing blocks."""
    shape = empty_report("repo-00")
    try:
        if report.keys() != shape.keys() or report["schema"] != SCHEMA or not g.valid_repository(report["repository"]):
            return False
        if any(report[k].keys() != shape[k].keys() for k in ("inventory", "retrieval", "performance")) or set(report["capability_gaps"]) != set(g.CATEGORIES):
            return False
        i = report["inventory"]
        known = (set(i["size_bands"]) <= {b for b, _ in e.SIZE_BANDS} | {e.LAST_BAND}, set(i["symbol_kinds"]) <= {*KINDS, "other"}, set(i["supported_languages"]) <= set(m.LANGUAGES), set(report["blockers"]) <= set(BLOCKERS))
        sums = all(sum(i[k].values()) == i["included_files"] for k in ("supported_languages", "size_bands"))
        late = ("too_large", "binary", "invalid_utf8", "generated", "secret")
        eligible = i["included_files"] <= i["eligible_files"] <= i["included_files"] + sum(i["excluded_by_category"].get(k, 0) for k in late)
        rates = [report["retrieval"][k] for k in ("citation_validity", "deterministic_order_rate")] + [c[k] for c in report["retrieval"]["categories"].values() for k in (*_METRICS, "no_evidence_accuracy")]
        decided = (report["decision"] == "go") == (sum(report["blockers"].values()) == 0)
        return all(known) and (not i["size_bands"] or sums) and eligible and all(0 <= r <= 1 for r in rates) and decided and not re.search(r"[/\\]", json.dumps({k: v for k, v in report.items() if k not in ("inventory",)}))
    except (KeyError, TypeError, AttributeError):
        return False


def marshal(report: dict, most: int = MAX_REPORT_BYTES) -> bytes:
    if not valid_report(report):
        raise m.EvaluationError("integrity")
    data = json.dumps(report, sort_keys=True, indent=2).encode() + b"\n"
    if len(data) > most:
        raise m.EvaluationError("budget")
    return data


def publish_report(path: str, data: bytes, root: str) -> None:
    """Write a new file, whole or not at all, in a private folder outside the root."""
    folder = os.path.dirname(path)
    inside = os.path.realpath(folder) == os.path.realpath(root) or os.path.realpath(folder).startswith(os.path.realpath(root) + os.sep)
    if not os.path.isabs(path) or os.path.normpath(path) != path or not os.path.isdir(folder) or os.path.islink(folder) or os.stat(folder).st_mode & 0o077 or inside:
        raise m.EvaluationError("location")
    temp = os.path.join(folder, f".{os.path.basename(path)}.{os.getpid()}")
    fd = os.open(temp, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temp, path)
        except FileExistsError:
            raise m.EvaluationError("location") from None
    finally:
        os.unlink(temp)
