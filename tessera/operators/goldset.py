"""Gold sets and checklists: private inputs of an evaluation, read strictly and never echoed."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.model import SCAN_POLICY, GoldSetError, valid_reference
from tessera.operators.evaluate import resolve_judgments
from tessera.sources.strict_json import BadJson, loads, shaped

MAX_GOLD_BYTES = 1 << 20
MAX_CASES, MAX_JUDGMENTS, LEAST_PER_CATEGORY = 1000, 100, 5
CATEGORIES = ("exact_symbol", "concept", "cross_layer", "framework", "error_message", "configuration_path", "negative_evidence")
_REPOSITORY = re.compile(r"repo-[a-f0-9]{2,64}")
_CASE = re.compile(r"case-[a-z0-9][a-z0-9-]{1,63}")
_CASE_SHAPE = {"id": str, "category": str, "query": str, "expectation": str, "judgments": list}
CASE_COLUMNS = "case_id string, category string, query string, expectation string"
JUDGMENT_COLUMNS = "case_id string, path string, start_line int, end_line int, relevance int"


@dataclass(frozen=True)
class GoldSet:
    cases: tuple[tuple[str, str, str, str], ...]
    judgments: tuple[tuple[str, str, int, int, int], ...]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.createDataFrame(list(self.cases), CASE_COLUMNS), spark.createDataFrame(list(self.judgments), JUDGMENT_COLUMNS)


def _private(text: str, most: int = 4096) -> bool:
    return 1 <= len(text.encode("utf-8", "surrogatepass")) <= most and bool(text.strip())


def valid_repository(name: str) -> bool:
    return bool(_REPOSITORY.fullmatch(name))


def parse_gold_set(payload: bytes, repository: str, policy: str = SCAN_POLICY) -> GoldSet:
    try:
        return _parsed(payload, repository, policy)
    except BadJson:
        raise GoldSetError("invalid gold set") from None


def _need(ok) -> None:
    if not ok:
        raise BadJson("content")


def _parsed(payload: bytes, repository: str, policy: str) -> GoldSet:
    root = shaped(loads(payload, MAX_GOLD_BYTES), {"schema": int, "repository": str, "scan_policy_version": str, "cases": list})
    _need(valid_repository(repository) and policy == SCAN_POLICY)
    _need((root["schema"], root["repository"], root["scan_policy_version"]) == (1, repository, policy) and 1 <= len(root["cases"]) <= MAX_CASES)
    cases, judgments = [], []
    for raw in root["cases"]:
        case = shaped(raw, _CASE_SHAPE)
        negative = case["category"] == "negative_evidence"
        _need(_CASE.fullmatch(case["id"]) and case["category"] in CATEGORIES and _private(case["query"]))
        _need(case["expectation"] == ("no_evidence" if negative else "relevant"))
        _need(not case["judgments"] if negative else 1 <= len(case["judgments"]) <= MAX_JUDGMENTS)
        cases.append((case["id"], case["category"], case["query"], case["expectation"]))
        for item in case["judgments"]:
            judgment = shaped(item, {"reference": dict, "relevance": int})
            place = shaped(judgment["reference"], {"path": str, "start_line": int, "end_line": int})
            _need(valid_reference(*place.values()) if list(place) == ["path", "start_line", "end_line"] else valid_reference(place["path"], place["start_line"], place["end_line"]))
            _need(_private(place["path"]) and 1 <= judgment["relevance"] <= 3)
            judgments.append((case["id"], place["path"], place["start_line"], place["end_line"], judgment["relevance"]))
    once = lambda values: max(Counter(values).values(), default=1) == 1
    _need(once(c[0] for c in cases) and once(c[1:3] for c in cases) and once(j[:4] for j in judgments))
    _need(min(Counter(c[1] for c in cases).values()) >= LEAST_PER_CATEGORY)
    return GoldSet(tuple(cases), tuple(judgments))


def resolved(gold: GoldSet, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, qrels); every judgment must be the place of exactly one chunk."""
    cases, judgments = gold.frames(chunks.sparkSession)
    found = resolve_judgments(judgments, chunks)
    if found.where("matches <> 1").limit(1).count():
        raise GoldSetError("a judgment doesn't match one chunk")
    return cases, found.select("case_id", "chunk_id", "relevance")


# The keys of a checklist.
GATES = (
    "owner_authorized", "root_read_only", "task_13_taint_gate_passed", "semantic_fixed_off", "external_network_prohibited",
    "output_reviewed_as_aggregates", "cache_output_outside_repository", "rollback_is_cache_discard",
)
#: Budgets and the most that each may be.
BUDGETS = {
    "max_duration_milliseconds": 24 * 3600 * 1000, "max_eligible_bytes": 1 << 40, "max_eligible_files": 10_000_000, "max_output_bytes": 16 << 20, "max_auto_queries": 1_000_000,
}


@dataclass(frozen=True)
class Checklist:
    gates: dict
    budgets: dict

    @property
    def blockers(self) -> int:
        return sum(not v for v in self.gates.values()) + sum(not 0 < self.budgets[k] <= most for k, most in BUDGETS.items())


def parse_checklist(payload: bytes) -> Checklist:
    try:
        root = shaped(loads(payload, 64 << 10), {**dict.fromkeys(GATES, bool), "budgets": dict})
        budgets = shaped(root["budgets"], dict.fromkeys(BUDGETS, int))
    except BadJson:
        raise GoldSetError("invalid checklist") from None
    return Checklist({g: root[g] for g in GATES}, budgets)
