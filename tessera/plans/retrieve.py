"""Answering a query on a bound generation: lexical, or hybrid with a defined fallback."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from tessera import model as m
from tessera.operators import search
from tessera.plans.store import BoundReader
from tessera.sources.embedding import Embedder

DEADLINE_S, MAX_DEADLINE_S = 3.0, 300.0
#: Failures of the semantic side that a preferred hybrid query survives.
DEGRADABLE = (m.SemanticUnavailable, m.VectorUnavailable, m.IncompatibleSpace, m.GenerationChanged, Late)


@dataclass(frozen=True)
class Event:
    """What an observer sees: nothing of query, text or path."""

    backend: str
    kind: str
    reason: str
    seconds: float


@dataclass(frozen=True)
class Answer:
    """mode: lexical, hybrid or fallback; a fallback's scores are lexical ones."""

    hits: DataFrame
    mode: str


def _query_vector(embedder: Embedder, text: str) -> tuple[list[float], m.VectorSpace]:
    profile = embedder.profile()
    batch = embedder.embed([text])
    if batch.profile != profile or len(batch.vectors) != 1:
        raise m.InvalidQueryVector("invalid query vector")
    return batch.vectors[0], m.VectorSpace(profile.fingerprint, profile.model, batch.dimensions)


def retrieve(reader: BoundReader, query: m.Query, mode: str = "off", embedder: Embedder | None = None, deadline_s: float = 0, observer: Callable[[Event], None] | None = None, **fusion) -> Answer:
    """mode: off, preferred (falls back to lexical hits) or required. The deadline holds for embedding and vector search together;
    both sides' hits, 200 at most, are checked before they are fused."""
    if mode not in ("off", "preferred", "required") or (mode != "off" and embedder is None) or not 0 <= deadline_s <= MAX_DEADLINE_S:
        raise m.InvalidConfig("invalid retrieval settings")
    if mode == "off":
        return Answer(reader.lexical(query), "lexical")
    search.fusion_settings(**{k: v for k, v in fusion.items() if k != "check"})
    window = replace(query, limit=search.candidate_window(query.limit))
    began, spark = time.monotonic(), reader.spark

    def tell(backend: str, kind: str, reason: str = "") -> None:
        if observer:
            try:
                observer(Event(backend, kind, reason, time.monotonic() - began))
            except Exception:  # an observer can't break a query
                pass

    def table(rows, schema) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    job, late = f"semantic-{uuid.uuid4().hex}", deadline_s or DEADLINE_S

    def semantic():
        spark.sparkContext.setJobGroup(job, "semantic search", interruptOnCancel=True)
        reader.describe()
        found = reader.semantic(window, *_query_vector(embedder, query.text))
        try:
            return search.validated(found.collect()), found.schema
        except PySparkException as e:
            raise m.VectorFailure("vector search failed") from e

    pool = ThreadPoolExecutor(1)
    try:
        vector = pool.submit(inheritable_thread_target(spark)(semantic))
        try:
            found = reader.lexical(window)
            lexical = table(search.validated(found.collect()), found.schema)
        except m.InvalidQuery:
            raise
        except (m.EngineError, PySparkException) as e:
            tell("lexical", "error")
            raise e if isinstance(e, m.EvidenceIntegrity) else m.LexicalFailure("lexical search failed") from e
        tell("lexical", "ok")
        try:
            hits = search.fuse(lexical, table(*vector.result(timeout=max(0.0, began + late - time.monotonic()))), query.limit, check=True, **fusion)
        except DEGRADABLE as e:
            tell("vector", "degraded", type(e).__name__)
            if mode == "required":
                raise m.SemanticUnavailable() if isinstance(e, Late) else e
            return Answer(search.fallback(lexical, query.limit), "fallback")
        except m.EngineError:
            tell("vector", "error")
            raise
        tell("vector", "ok")
        return Answer(hits, "hybrid")
    finally:
        if not vector.done():
            spark.sparkContext.cancelJobGroup(job)
        pool.shutdown(wait=False, cancel_futures=True)
