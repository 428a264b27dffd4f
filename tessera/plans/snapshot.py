"""The default index: one generation of chunks per repository, replaced in one step; and its use as a rollback of a store.

    <root>/<hash>.json             the head: what the snapshot is of, and in which folder its chunks lie; swapped by an atomic rename
    <root>/<hash>.<token>/chunks/  the chunks by ranges of a walk's order, written and read by tasks; the head has each range's first ordinal
    <root>/<hash>.rollback         the marker

The head is small whatever the corpus, so a snapshot has no largest size. A writer holds its folder's lease until its head stands.
The folder that a snapshot replaces stays until the next one, as frames that were loaded before still read it.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import secrets
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model as m
from tessera.operators.ordinals import offsets, placed_in, ranged
from tessera.operators.search import with_tokens
from tessera.plans.store import CODEC, _lease, _uri, chunk_faults, content_digest, revision, walk
from tessera.sources.strict_json import BadJson, loads, shaped

VERSION = 3
#: Of a head.
MAX_BYTES = 64 << 20
MAX_MARKER_BYTES = 1024
_HEAD = {"version": int, "repository": str, "policy": str, "revision": str, "content": str, "chunks": int, "least": str, "most": str, "folder": str, "ranges": list}
_MARKER = {"version": int, "repository": str, "policy": str, "revision": str, "generation": str}
_SCHEMA = "chunk_id string, text string, language string, symbol_name string, path string, start_line int, end_line int, ordinal int"
_STORED = _SCHEMA.replace("ordinal int", "ordinal long")
_COLUMNS = [x.split() for x in _SCHEMA.split(", ")][:-1]


def _name(repository_id: str) -> str:
    if not repository_id or not repository_id.strip():
        raise m.InvalidRepository("invalid repository")
    return hashlib.sha256(repository_id.encode()).hexdigest()


def _replace(path: str, data: bytes) -> None:
    temp = f"{path}.{secrets.token_hex(6)}"
    with os.fdopen(os.open(temp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
    folder = os.open(os.path.dirname(path), os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, make: bool = False):
        if make:
            os.makedirs(root, mode=0o700, exist_ok=True)
        if not os.path.isdir(root):
            raise m.NotFound("no snapshots")
        self.spark, self.root = spark, root

    def _path(self, repository_id: str, kind: str = "json") -> str:
        return os.path.join(self.root, f"{_name(repository_id)}.{kind}")

    def _stored(self, folder: str) -> DataFrame:
        return self.spark.read.schema(_STORED).parquet(_uri(os.path.join(self.root, folder, "chunks")))

    def _rows(self, folder: str, ranges: list) -> DataFrame:
        return placed_in(self._stored(folder), [tuple(r) for r in ranges], "ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))

    def _head(self, repository_id: str) -> dict:
        try:
            with open(self._path(repository_id), "rb") as f:
                data = f.read(MAX_BYTES + 1)
        except FileNotFoundError:
            raise m.NotFound("no snapshot") from None
        if len(data) > MAX_BYTES:
            raise m.SnapshotTooLarge("the snapshot's head is larger than the limit")
        try:
            head = shaped(loads(data, MAX_BYTES), _HEAD)
        except BadJson:
            raise m.ReindexRequired("another snapshot format") from None
        name, _, token = head["folder"].partition(".")
        if name != _name(repository_id) or not token.isalnum():
            raise m.ReindexRequired("another snapshot's folder")
        if any(not isinstance(r, list) or [type(x) for x in r] != [int, int] for r in head["ranges"]):
            raise m.ReindexRequired("another snapshot format")
        return head

    def _folder(self, repository_id: str) -> str | None:
        """Where the snapshot lies now, if there is one that can be read."""
        try:
            return self._head(repository_id)["folder"]
        except m.EngineError:
            return None

    def replace(self, repository_id: str, chunks: DataFrame, policy: str) -> str:
        """Write the snapshot; its revision. The rollback marker goes first, as it no longer fits."""
        folder = f"{_name(repository_id)}.{secrets.token_hex(6)}"
        place = os.path.join(self.root, folder)
        os.mkdir(place, mode=0o700)
        lease = _lease(place, fcntl.LOCK_EX)
        try:
            ranged(chunks.select(*(F.col(c).cast(kind) for c, kind in _COLUMNS)), *walk(), name="ordinal").write.parquet(_uri(f"{place}/chunks"), compression=CODEC)
            ranges = offsets(self._stored(folder), "ordinal")
            rows = self._rows(folder, ranges)
            found = chunk_faults(rows).first()
            if found["invalid"] or found["repeated"]:
                raise m.InvalidChunk("invalid chunk")
            stated = revision(policy, rows)
            head = {"version": VERSION, "repository": repository_id, "policy": policy, "revision": stated, "content": content_digest(rows), "chunks": found["chunks"], "least": found["least"] or "", "most": found["most"] or "", "folder": folder, "ranges": ranges}
            data = json.dumps(head, ensure_ascii=False).encode()
            if len(data) > MAX_BYTES:
                raise m.SnapshotTooLarge("the snapshot's head is larger than the limit")
            before = self._folder(repository_id)
            self.unmark(repository_id)
            _replace(self._path(repository_id), data)
        except BaseException:
            shutil.rmtree(place, ignore_errors=True)
            raise
        finally:
            os.close(lease)
        self._clean(repository_id, before)
        return stated

    def _clean(self, repository_id: str, before: str | None) -> None:
        """Remove the folders of earlier snapshots, but for the last one and those that are being written."""
        for folder in os.listdir(self.root):
            place = os.path.join(self.root, folder)
            if not folder.startswith(f"{_name(repository_id)}.") or not os.path.isdir(place):
                continue
            lease = _lease(place, fcntl.LOCK_EX)
            if lease is None:
                continue
            try:
                if folder not in (before, self._folder(repository_id)):  # read under the lease: a writer gives it up once its head stands
                    shutil.rmtree(place, ignore_errors=True)
            finally:
                os.close(lease)

    def load(self, repository_id: str, policy: str = m.SCAN_POLICY) -> tuple[DataFrame, str]:
        """(chunks with tokens, revision), after all checks."""
        head = self._head(repository_id)
        fits = (head["version"], head["repository"], head["policy"]) == (VERSION, repository_id, policy)
        if not fits or not os.path.isdir(os.path.join(self.root, head["folder"], "chunks")):
            raise m.ReindexRequired("another snapshot")
        rows = self._rows(head["folder"], head["ranges"])
        found = chunk_faults(rows).first()
        same = (found["chunks"], found["least"] or "", found["most"] or "", found["invalid"], found["repeated"]) == (head["chunks"], head["least"], head["most"], 0, 0)
        if not same or revision(policy, rows) != head["revision"] or content_digest(rows) != head["content"]:
            raise m.ReindexRequired("another snapshot")
        return with_tokens(rows), head["revision"]

    # the marker says that the snapshot holds the corpus of a store's generation

    def mark(self, repository_id: str, policy: str, revision: str, generation: str) -> None:
        value = {"version": 1, "repository": _name(repository_id), "policy": policy, "revision": revision, "generation": generation}
        _replace(self._path(repository_id, "rollback"), json.dumps(value, sort_keys=True).encode())

    def unmark(self, repository_id: str) -> None:
        try:
            os.unlink(self._path(repository_id, "rollback"))
        except FileNotFoundError:
            pass

    def marker(self, repository_id: str) -> dict:
        path = self._path(repository_id, "rollback")
        try:
            fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW)
        except OSError:
            raise m.NotFound("no rollback marker") from None
        with os.fdopen(fd, "rb") as f:
            if os.fstat(fd).st_mode & 0o077:
                raise m.ReindexRequired("the marker isn't private")
            data = f.read(MAX_MARKER_BYTES + 1)
        try:
            value = shaped(loads(data, MAX_MARKER_BYTES), _MARKER)
        except BadJson:
            raise m.ReindexRequired("another marker format") from None
        if value["version"] != 1 or value["repository"] != _name(repository_id):
            raise m.ReindexRequired("another repository's marker")
        return value

    def rollback(self, repository_id: str, manifest) -> DataFrame:
        """The snapshot's chunks, if marker, snapshot and the store's manifest agree."""
        mark, (chunks, stated) = self.marker(repository_id), self.load(repository_id, manifest.scan_policy_version)
        if (mark["policy"], mark["revision"], mark["generation"]) != (manifest.scan_policy_version, manifest.corpus_revision, manifest.generation_id) or stated != manifest.corpus_revision:
            raise m.ReindexRequired("the rollback doesn't fit the store")
        return chunks
