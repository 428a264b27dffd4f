"""Shared types, constants and errors.

Error messages never carry source text, query text or secrets.
"""

from __future__ import annotations

from dataclasses import dataclass

SCAN_POLICY = "scanner-v6"
CORPUS_VERSION = "corpus-v1"
GENERATION_VERSION = "generation-v1"
MANIFEST_VERSION = "generation-manifest-v1"
LANGUAGES = ("javascript", "python", "typescript")

CHUNK = (
    "chunk_id string, ordinal int, text string, language string, symbol_name string, path string, start_line int, end_line int, "
    "text_tokens array<string>, symbol_tokens array<string>, path_tokens array<string>"
)
VECTOR = "chunk_id string, ordinal int, path string, start_line int, end_line int, language string, encoding_version int, dimensions int, values array<float>"
FILE = "path string, language string, content binary"


class EngineError(Exception):
    """Base of all errors the engine raises on purpose."""


class NotFound(EngineError): ...


class InvalidQuery(EngineError): ...


class InvalidFilter(InvalidQuery): ...


class InvalidConfig(EngineError): ...


class InvalidRepository(EngineError): ...


class InvalidChunk(EngineError): ...


class InvalidCorpus(EngineError): ...


class InvalidGeneration(EngineError): ...


class InvalidReference(EngineError): ...


class UnsupportedLanguage(EngineError): ...


class CostLimit(EngineError): ...


class ReindexRequired(EngineError): ...


class ConcurrentIndex(EngineError): ...


class CleanupIncomplete(EngineError):
    """Published, but what it replaced could not all be removed."""


class SnapshotTooLarge(EngineError): ...


class SemanticUnavailable(EngineError):
    def __init__(self, message: str = "semantic provider unavailable", attempts: int = 0):
        super().__init__(message)
        self.attempts = attempts


class InvalidBatch(EngineError): ...


class InvalidVector(EngineError): ...


class InvalidQueryVector(EngineError): ...


class IncompatibleSpace(EngineError): ...


class VectorUnavailable(EngineError): ...


class VectorIntegrity(EngineError): ...


class GenerationChanged(EngineError): ...


class LexicalFailure(EngineError): ...


class VectorFailure(EngineError): ...


class EvidenceIntegrity(EngineError): ...


class GoldSetError(EngineError): ...


class MetricsError(EngineError): ...


class EvaluationError(EngineError):
    def __init__(self, category: str):
        super().__init__(category)
        self.category = category


@dataclass(frozen=True)
class Filter:
    """Path prefixes and languages: either list admits any of its values, both must admit a chunk."""

    path_prefixes: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    repository_id: str
    text: str
    limit: int = 10
    filter: Filter = Filter()


@dataclass(frozen=True)
class VectorSpace:
    """What a stored generation's vectors are: who made them and how long they are."""

    fingerprint: str
    model: str
    dimensions: int


def valid_path(path: str) -> bool:
    """A clean relative path inside the repository."""
    if not path or path.startswith("/") or "\\" in path or path == ".":
        return False
    return all(part not in ("", ".", "..") for part in path.split("/"))


def valid_reference(path: str, start: int, end: int) -> bool:
    return valid_path(path) and 0 < start <= end
