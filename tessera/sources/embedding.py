"""Where vectors come from: a protocol, an offline embedder, a client for the usual HTTP interface, and the embedding of a table by tasks."""

from __future__ import annotations

import hashlib
import http.client
import ipaddress
import json
import math
import ssl
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import model
from tessera.model import InvalidBatch, InvalidConfig, InvalidVector, SemanticUnavailable

BATCH_ITEMS, BATCH_BYTES, IN_FLIGHT, TIMEOUT_S, ATTEMPTS, PAUSE_S = 32, 256 << 10, 2, 30.0, 3, 0.1
MAX_BATCH_ITEMS, MAX_IN_FLIGHT = 128, 8


@dataclass(frozen=True)
class Profile:
    fingerprint: str
    model: str


@dataclass(frozen=True)
class Batch:
    profile: Profile
    dimensions: int
    vectors: list[list[float]]
    requests: int
    usage_tokens: int = 0
    #: Places of texts without a direction of their own, whose vectors only stand in for one.
    stand_ins: frozenset[int] = frozenset()


class Embedder(Protocol):
    def profile(self) -> Profile: ...

    def embed(self, texts: Sequence[str]) -> Batch: ...


def checked_batch(batch: Batch, n: int, profile: Profile) -> Batch:
    """The batch, if it answers n texts under the profile with usable vectors of one length."""
    if batch.profile != profile or not profile.fingerprint or not profile.model or len(batch.vectors) != n or batch.dimensions <= 0 or batch.requests <= 0 or batch.usage_tokens < 0:
        raise InvalidBatch("invalid embedding batch")
    for v in batch.vectors:
        if len(v) != batch.dimensions or not all(math.isfinite(x) for x in v) or not any(v):
            raise InvalidVector("invalid embedding vector")
    return batch


def unit(vector: Sequence[float]) -> list[float]:
    """To length 1, dividing by the largest component first so that no square overflows."""
    v = np.asarray(vector, np.float64)
    if not len(v) or not np.isfinite(v).all() or not v.any():
        raise InvalidVector("invalid embedding vector")
    v = v / np.abs(v).max()
    return [float(x) for x in (v / math.sqrt(float((v * v).sum()))).astype(np.float32)]


@dataclass(frozen=True)
class HashEmbedder:
    """Offline and deterministic: tokens hashed into a few dimensions. For tests and for use without a provider.

    Words are lower-cased a code point at a time. A text without words, or whose words cancel out, gets a vector that stands in.
    """

    dimensions: int = 64

    def profile(self) -> Profile:
        return Profile(hashlib.sha256(f"hash/{self.dimensions}".encode()).hexdigest(), f"hash-{self.dimensions}")

    def embed(self, texts: Sequence[str]) -> Batch:
        rows, stand_ins = [], []
        for text in texts:
            v = np.zeros(self.dimensions)
            words = text.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower().split()  # the two that str.lower() maps otherwise
            for word in words or [""]:
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            if not words or not v.any():
                stand_ins.append(len(rows))
            rows.append(unit(v if v.any() else np.eye(1, self.dimensions)[0]))
        return Batch(self.profile(), self.dimensions, rows, 1, stand_ins=frozenset(stand_ins))


@dataclass(frozen=True)
class ProviderConfig:
    base_url: str
    model: str
    dimensions: int = 0
    api_key: str = field(default="", repr=False)
    batch_items: int = BATCH_ITEMS
    batch_bytes: int = BATCH_BYTES
    in_flight: int = IN_FLIGHT
    timeout_s: float = TIMEOUT_S

    def __post_init__(self):
        u = urlsplit(self.base_url)
        port_ok = True
        try:
            _ = u.port
        except ValueError:
            port_ok = False
        plain = port_ok and u.hostname and not (u.username or u.password or u.query or u.fragment or "?" in self.base_url or "#" in self.base_url) and u.path.rstrip("/") == "/v1"
        if not plain or u.scheme not in ("https", "http") or (u.scheme == "http" and not self.local):
            raise InvalidConfig("invalid provider url")
        if not self.model.strip() or self.dimensions < 0 or not 0 < self.batch_items <= MAX_BATCH_ITEMS or self.batch_bytes <= 0 or not 0 < self.in_flight <= MAX_IN_FLIGHT or self.timeout_s <= 0:
            raise InvalidConfig("invalid provider settings")

    @property
    def local(self) -> bool:
        """Whether the host is a loopback address, spelled as one."""
        try:
            return ipaddress.ip_address(urlsplit(self.base_url).hostname or "").is_loopback
        except ValueError:
            return False

    @property
    def fingerprint(self) -> str:
        """Of what decides the vectors; the key isn't part of it."""
        u = urlsplit(self.base_url)
        what = {"dimensions": self.dimensions, "endpoint": f"{u.scheme}://{u.netloc.lower()}/v1", "model": self.model, "version": 1}
        return hashlib.sha256(json.dumps(what, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class _Passing(Exception):
    """A failure that another attempt may mend; after how many seconds, if the server says."""

    def __init__(self, after: float | None = None):
        self.after = after


class HttpEmbedder:
    """POST {base}/embeddings, without proxies or redirects."""

    def __init__(self, config: ProviderConfig, sleep: Callable[[float], None] = time.sleep):
        self.config, self._sleep = config, sleep

    def profile(self) -> Profile:
        return Profile(self.config.fingerprint, self.config.model)

    def _payload(self, texts: Sequence[str]) -> bytes:
        body = {"model": self.config.model, "input": list(texts), "encoding_format": "float"}
        if self.config.dimensions:
            body["dimensions"] = self.config.dimensions
        return json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()

    def batches(self, texts: Sequence[str]) -> list[tuple[int, bytes]]:
        """(number of texts, request body): as many texts as fit, in order."""
        out, part = [], []
        for text in texts:
            if part and (len(part) == self.config.batch_items or len(self._payload([*part, text])) > self.config.batch_bytes):
                out.append((len(part), self._payload(part)))
                part = []
            part.append(text)
            if len(part) == 1 and len(self._payload(part)) > self.config.batch_bytes:
                raise InvalidBatch("a text is too large for a request")
        return [*out, (len(part), self._payload(part))] if part else out

    def embed(self, texts: Sequence[str]) -> Batch:
        if not texts:
            raise InvalidBatch("no texts")
        work = self.batches(texts)
        deadline = time.monotonic() + self.config.timeout_s
        with ThreadPoolExecutor(self.config.in_flight) as pool:
            jobs = [pool.submit(self._with_retries, n, body, deadline) for n, body in work]
            done, waiting = wait(jobs, return_when=FIRST_EXCEPTION)
            for j in waiting:  # whichever request failed first stops those that haven't begun
                j.cancel()
            for j in jobs:
                if j in done and j.exception():
                    raise j.exception()
            results = [j.result() for j in jobs]
        vectors = [v for part, _, _ in results for v in part]
        if len({len(v) for v in vectors}) != 1:
            raise InvalidBatch("vectors of different lengths")
        return Batch(self.profile(), len(vectors[0]), vectors, sum(r for _, _, r in results), sum(u for _, u, _ in results))

    def _with_retries(self, n: int, body: bytes, deadline: float) -> tuple[list[list[float]], int, int]:
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return (*self._decoded(n, self._request(body, deadline)), attempt)
            except _Passing as e:
                pause = PAUSE_S * 2 ** (attempt - 1) if e.after is None else e.after
                if attempt == ATTEMPTS or time.monotonic() + pause >= deadline:
                    raise SemanticUnavailable(attempts=attempt) from None
                self._sleep(pause)
        raise SemanticUnavailable(attempts=ATTEMPTS)

    def _request(self, body: bytes, deadline: float) -> bytes:
        u = urlsplit(self.config.base_url)
        left = deadline - time.monotonic()
        if left <= 0:
            raise SemanticUnavailable()
        kind = (lambda *a, **k: http.client.HTTPSConnection(*a, context=ssl.create_default_context(), **k)) if u.scheme == "https" else http.client.HTTPConnection
        connection = kind(u.hostname, u.port, timeout=left)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.config.api_key}"} if self.config.api_key else {})
        try:
            connection.request("POST", "/v1/embeddings", body, headers)
            answer = connection.getresponse()
            data = answer.read(64 << 20)
            status, after = answer.status, answer.getheader("Retry-After")
        except (OSError, http.client.HTTPException):
            raise _Passing() from None
        finally:
            connection.close()
        if status in (408, 429) or status >= 500:
            raise _Passing(float(after) if after and after.isdigit() else None)
        if status != 200:
            raise SemanticUnavailable(attempts=1)
        return data

    def _decoded(self, n: int, data: bytes) -> tuple[list[list[float]], int]:
        try:
            root = json.loads(data)
            rows, usage = root["data"], int((root.get("usage") or {}).get("total_tokens", 0))
            by_index = {int(r["index"]): [float(x) for x in r["embedding"]] for r in rows}
        except (ValueError, KeyError, TypeError, AttributeError):
            raise InvalidBatch("malformed answer") from None
        if len(rows) != n or sorted(by_index) != list(range(n)) or usage < 0:
            raise InvalidBatch("missing or repeated vectors")
        vectors = [by_index[i] for i in range(n)]
        if any(self.config.dimensions and len(v) != self.config.dimensions for v in vectors):
            raise InvalidBatch("vectors of another length")
        return [unit(v) for v in vectors], usage


# --- tables ----------------------------------------------------------------------------------------

#: Tasks that ask the provider at a time, each with up to ``in_flight`` requests; texts and bytes that a task holds for one round of them.
CLIENTS, ROUND_ITEMS, ROUND_BYTES = 4, 256, 2 << 20
_EMBEDDED = "chunk_id string, values array<float>, requests long, usage_tokens long, error string, attempts int, stand_in boolean"
_TYPES = [pa.string(), pa.list_(pa.float32()), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()]
#: Failures that are told by a row; others end the job.
_TOLD = (SemanticUnavailable, InvalidBatch, InvalidVector)


def _rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """(ids, texts), so many as one round of requests takes."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, text in zip(b["chunk_id"].to_pylist(), b["text"].to_pylist()):
            n = len(text.encode())
            if ids and (len(ids) == ROUND_ITEMS or size + n > ROUND_BYTES):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(text)
            size += n
    if ids:
        yield ids, texts


def embedded(chunks: DataFrame, embedder: Embedder, clients: int = CLIENTS) -> DataFrame:
    """(chunk_id, values, requests, usage_tokens, error, attempts, stand_in) of chunks (chunk_id, text), by tasks.

    Texts go from where they are read to the provider. There are ``clients`` tasks, so no more than that many times the embedder's own
    requests are in flight. A round's requests and tokens stand in its first row. A failure is a row with its class and ends its task's
    work: were it the task's, Spark would send the same texts again.
    """
    profile = embedder.profile()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _EMBEDDED.split(", ")]
        for ids, texts in _rounds(batches):
            n = len(ids)
            try:
                found = checked_batch(embedder.embed(texts), n, profile)
                columns = [ids, found.vectors, [found.requests] + [0] * (n - 1), [found.usage_tokens] + [0] * (n - 1), [None] * n, [0] * n, [i in found.stand_ins for i in range(n)]]
            except _TOLD as e:
                columns = [[None], [None], [0], [0], [type(e).__name__], [getattr(e, "attempts", 0)], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)
            if columns[4][0]:
                return

    return chunks.select("chunk_id", "text").repartition(clients).mapInArrow(run, _EMBEDDED)


def outcome(rows: DataFrame) -> tuple[int, int, int]:
    """(dimensions, requests, tokens) of a stored table of ``embedded`` rows, or the error that one of them tells."""
    size = F.size("values")
    r = rows.agg(F.min("error"), F.max("attempts"), F.min(F.when(size >= 0, size)), F.max(size), F.sum("requests"), F.sum("usage_tokens")).first()
    if r[0]:
        kind = getattr(model, r[0])
        raise kind(attempts=r[1]) if kind is SemanticUnavailable else kind("embedding failed")
    if r[2] != r[3]:
        raise InvalidBatch("vectors of different lengths")
    return r[3] or 0, r[4] or 0, r[5] or 0
