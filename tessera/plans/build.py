"""From a tree or a corpus to a published generation, with or without vectors."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model as m
from tessera.operators.declarations import chunk_files
from tessera.plans.store import Manifest, Store
from tessera.session import small_batches, stored
from tessera.sources.embedding import CLIENTS, ROUND_ITEMS, Embedder, embedded, outcome
from tessera.sources.tree import ScanReport, scan

MAX_CHUNKS, MAX_TEXT_BYTES = 20_000, 64 << 20
MODES = ("off", "preferred", "required")
_CORPUS = ["chunk_id", "text", "language", "symbol_name", "path", "start_line", "end_line"]


@dataclass(frozen=True)
class Corpus:
    chunks: DataFrame
    policy: str
    report: ScanReport | None = None


@dataclass(frozen=True)
class Outcome:
    """status: indexed, or degraded if a preferred semantic side was not to be had."""

    manifest: Manifest
    status: str
    vectors: int = 0
    requests: int = 0
    usage_tokens: int = 0


def repository_id_of(root: str) -> str:
    return os.path.realpath(root)


def ingest(spark: SparkSession, root: str) -> Corpus:
    """Scan, parse and cut a tree."""
    files, report, policy = scan(spark, root)
    return Corpus(stored(chunk_files(files).select(*_CORPUS), "corpus"), policy, report)


def cost(chunks: DataFrame, most_chunks: int = MAX_CHUNKS, most_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """One row (chunks, bytes, admitted)."""
    own = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))
    return own.withColumn("admitted", (F.col("chunks") <= most_chunks) & (F.col("bytes") <= most_bytes))


def check_cost(chunks: DataFrame, most_chunks: int = MAX_CHUNKS, most_bytes: int = MAX_TEXT_BYTES) -> tuple[int, int]:
    n, size, admitted = cost(chunks, most_chunks, most_bytes).first()
    if not admitted:
        raise m.CostLimit("the corpus is larger than the limit")
    return n, size


def embed_chunks(chunks: DataFrame, embedder: Embedder, clients: int = CLIENTS) -> tuple[DataFrame, m.VectorSpace, int, int]:
    """(vectors frame, space, requests, tokens). Texts are sent by tasks; vectors are stored as they come."""
    small_batches(chunks.sparkSession)
    rows, profile = stored(embedded(chunks, embedder, clients), "embedded"), embedder.profile()
    try:
        dimensions, requests, tokens = outcome(rows)
    except m.InvalidVector as e:
        raise m.VectorIntegrity(str(e)) from None
    return rows.select("chunk_id", "values"), m.VectorSpace(profile.fingerprint, profile.model, dimensions), requests, tokens


def build(store: Store, repository_id: str, corpus: Corpus, mode: str = "off", embedder: Embedder | None = None) -> Outcome:
    """Check the cost, embed if asked to, and publish. What was published stays if anything fails."""
    if mode not in MODES or (mode != "off" and embedder is None):
        raise m.InvalidConfig("invalid semantic mode")
    n, _ = check_cost(corpus.chunks)
    base = store.active(repository_id)
    vectors = space = None
    requests, tokens, status = 0, 0, "indexed"
    if mode != "off" and n:
        try:
            clients = min(CLIENTS, -(-n // ROUND_ITEMS))  # a corpus of one round is no more than that
            vectors, space, requests, tokens = embed_chunks(corpus.chunks, embedder, clients)
        except m.SemanticUnavailable:
            if mode == "required":
                raise
            status = "degraded"
    manifest = store.publish(repository_id, corpus.chunks, corpus.policy, base, vectors, space)
    store.purge(repository_id)
    return Outcome(manifest, status, n if vectors is not None else 0, requests, tokens)
