"""Published indexes: immutable Parquet generations behind one pointer per repository.

    <root>/store.json                    format and a random identity, written last when a store is made
    <root>/lock                          the lock file; it is never removed
    <root>/repositories/<hash>/ACTIVE    which generation is published; swapped by an atomic rename
    <root>/repositories/<hash>/<id>/     manifest.json, lease, chunks/ and, if there are vectors, vectors/

Both tables lie in the order of a walk (folder by folder), each file a range of it. Vectors have the columns that filter and
order hits beside them, so a search by vector is one scan without a shuffle, filters on paths skip what they can't meet, and
the texts of the best hits are read by their ordinals. Ordinals and digests are taken in parallel: see ``ordinals`` and ``merkle``.

A generation is written whole beside the others, verified, and only then published, if the published one is still that
which it was built against. Readers verify a generation when they bind it, pin it and see nothing of later ones: each folder has
a lease, which a reader shares and a writer holds alone, in any process, and a purge leaves what is leased.
"""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import secrets
import shutil
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import model as m
from tessera.functions import digests
from tessera.functions.text import reference_ok
from tessera.operators import merkle, search
from tessera.operators.ordinals import numbered
from tessera.session import scratch

FORMAT = 3
METRIC = "cosine"
#: Of chunks on disk; texts and their tokens take much less than with the usual one.
CODEC = "zstd"
VECTOR_ENCODING = 1
UNIT_TOLERANCE = 1e-4
BUSY_S = 5.0


@dataclass(frozen=True)
class Manifest:
    repository_id: str
    generation_id: str
    corpus_revision: str
    content_digest: str
    scan_policy_version: str
    profile_fingerprint: str
    profile_model: str
    dimensions: int
    metric: str
    vector_digest: str

    def digest(self) -> str:
        semantic = [bool(self.profile_fingerprint.strip()), bool(self.profile_model.strip()), self.dimensions > 0]
        hexes = (self.corpus_revision, self.content_digest, self.vector_digest)
        named = self.repository_id.strip() and self.generation_id.strip() and self.scan_policy_version.strip()
        if not named or self.metric != METRIC or any(semantic) != all(semantic) or any(len(h) != 64 or set(h) - set("0123456789abcdef") for h in hexes):
            raise m.InvalidGeneration("invalid manifest")
        values = [m.MANIFEST_VERSION, self.repository_id, self.generation_id, self.corpus_revision, self.content_digest, self.scan_policy_version]
        values += ["semantic" if all(semantic) else "lexical-only", self.profile_fingerprint, self.profile_model, self.metric, self.vector_digest]
        return digests.framed([*values, self.dimensions.to_bytes(8, "big")])

    @property
    def space(self) -> m.VectorSpace | None:
        return m.VectorSpace(self.profile_fingerprint, self.profile_model, self.dimensions) if self.dimensions else None


# --- digests of tables -------------------------------------------------------------------------


def walk() -> list[Column]:
    """The order of a walk: files folder by folder, then lines."""
    return [F.split("path", "/"), F.col("start_line"), F.col("chunk_id")]


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks with their ordinal, stored in that order."""
    return numbered(chunks, *walk(), name="ordinal").withColumn("ordinal", F.col("ordinal").cast("int"))


def revision(policy: str, chunks: DataFrame) -> str:
    return merkle.of_sorted(chunks, "chunk_id", digests.revision_head(policy))


def content_digest(chunks: DataFrame) -> str:
    row = digests.framed_column([F.col("ordinal").cast("string"), *(F.col(c) for c in ("chunk_id", "text", "language", "symbol_name", "path")), F.col("start_line").cast("string"), F.col("end_line").cast("string")])
    return merkle.tree_digest(chunks, F.col("ordinal"), row, "chunks-v2")


def vector_digest(vectors: DataFrame | None) -> str:
    """Of vectors in the order of their chunks, with all of their columns."""
    if vectors is None:
        return digests.framed(["vectors-v2", (0).to_bytes(8, "big")])
    parts = [F.col(c).cast("string") for c in ("ordinal", "chunk_id", "path", "start_line", "end_line", "language", "encoding_version", "dimensions")]
    return merkle.tree_digest(vectors, F.col("ordinal"), digests.framed_column([*parts, merkle.floats_digest("values")]), "vectors-v2")


def beside(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Unit vectors (chunk_id, values) with the columns of their chunks that filter and order, in the chunks' order."""
    unit = vectors.select("chunk_id", search.normalized(F.col("values")).alias("values"))
    unit = unit.select("chunk_id", F.lit(VECTOR_ENCODING).alias("encoding_version"), F.size("values").alias("dimensions"), "values")
    both = unit.join(chunks.select("chunk_id", "ordinal", "path", "start_line", "end_line", "language"), "chunk_id", "left")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.select([f.split()[0] for f in m.VECTOR.split(", ")]).repartitionByRange(parts, "ordinal", "chunk_id").sortWithinPartitions("ordinal", "chunk_id")


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """One row (chunks, least, most, invalid, repeated): how many, their smallest and largest id, those that are no chunk, and ids of several."""
    sound = F.coalesce((F.col("chunk_id") != "") & (F.col("text") != "") & reference_ok(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(False))
    own = chunks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(~sound).alias("invalid"))
    return own.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.min("chunk_id").alias("least"), F.max("chunk_id").alias("most"), F.coalesce(F.sum("invalid"), F.lit(0)).alias("invalid"), F.count_if(F.col("n") > 1).alias("repeated"))


def check_chunks(chunks: DataFrame) -> None:
    found = chunk_faults(chunks).first()
    if found["invalid"] or found["repeated"]:
        raise m.InvalidCorpus("invalid or repeated chunk")


def vector_faults(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row (orphans, missing, repeated): vectors without a chunk, chunks without a vector, chunks with several."""
    own = vectors.groupBy("chunk_id").agg(F.count("*").alias("n"))
    both = own.join(chunks.select("chunk_id", F.lit(True).alias("known")), "chunk_id", "full_outer")
    orphans = F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0))
    return both.agg(orphans.alias("orphans"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"))


def check_vectors(chunks: DataFrame, vectors: DataFrame, dimensions: int) -> None:
    """One unit vector of the right length for every chunk, and none else."""
    norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ok = (F.col("encoding_version") == VECTOR_ENCODING) & (F.col("dimensions") == dimensions) & (F.size("values") == dimensions) & (F.abs(norm - 1) <= UNIT_TOLERANCE)
    if vectors.where(~F.coalesce(ok, F.lit(False))).limit(1).count() or any(vector_faults(chunks, vectors).first()):
        raise m.VectorIntegrity("vectors don't fit the chunks")


# --- the store -----------------------------------------------------------------------------------


def _write(path: str, value: dict) -> None:
    """Replace a small JSON file in one step."""
    temp = f"{path}.{secrets.token_hex(6)}"
    fd = os.open(temp, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def _read(path: str) -> dict | None:
    try:
        with open(path) as f:
            return json.load(f)
    except FileNotFoundError:
        return None
    except ValueError:
        raise m.ReindexRequired("unreadable store file") from None


def _uri(path: str) -> str:
    """The store is a folder that driver and executors share as files, whatever the session's own file system is."""
    return f"file://{os.path.abspath(path)}"


def _lease(folder: str, how: int) -> int | None:
    """An open lease on a folder, shared or alone; None if another process or reader has it otherwise."""
    fd = os.open(os.path.join(folder, "lease"), os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o600)
    try:
        fcntl.flock(fd, how | fcntl.LOCK_NB)
    except BlockingIOError:
        os.close(fd)
        return None
    return fd


class Store:
    """A store's folder. Making one is explicit; opening one never makes or mends anything."""

    def __init__(self, spark: SparkSession, root: str, identity: str):
        self.spark, self.root, self.identity = spark, root, identity

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> Store:
        for folder in (root, os.path.join(root, "repositories")):
            os.makedirs(folder, mode=0o700, exist_ok=True)
        os.close(os.open(os.path.join(root, "lock"), os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW, 0o600))
        with cls._held(os.path.join(root, "lock")):
            if _read(os.path.join(root, "store.json")) is None:
                _write(os.path.join(root, "store.json"), {"format": FORMAT, "id": secrets.token_hex(32)})
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        if os.path.islink(root) or not os.path.isdir(root):
            raise m.NotFound("no store")
        if os.stat(root).st_mode & 0o077:
            raise m.InvalidRepository("the store's folder isn't private")
        head = _read(os.path.join(root, "store.json"))
        if head is None:
            raise m.NotFound("no store")
        if set(head) != {"format", "id"} or head["format"] != FORMAT or len(str(head["id"])) != 64:
            raise m.ReindexRequired("another store format")
        return cls(spark, root, head["id"])

    @staticmethod
    @contextmanager
    def _held(path: str) -> Iterator[None]:
        fd = os.open(path, os.O_RDWR | os.O_NOFOLLOW)
        try:
            until = time.monotonic() + BUSY_S
            while True:
                try:
                    fcntl.flock(fd, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() > until:
                        raise m.ConcurrentIndex("the store is busy") from None
                    time.sleep(0.01)
            yield
        finally:
            os.close(fd)

    def _place(self, repository_id: str) -> str:
        if not repository_id or not repository_id.strip():
            raise m.InvalidRepository("invalid repository")
        return os.path.join(self.root, "repositories", hashlib.sha256(repository_id.encode()).hexdigest())

    def active(self, repository_id: str) -> str | None:
        pointer = _read(os.path.join(self._place(repository_id), "ACTIVE"))
        return pointer and pointer["generation"]

    def publish(self, repository_id: str, chunks: DataFrame, policy: str, base: str | None, vectors: DataFrame | None = None, space: m.VectorSpace | None = None) -> Manifest:
        """Publish a generation built while ``base`` was the published one. Publishing what is published changes nothing."""
        if (vectors is None) != (space is None):
            raise m.InvalidGeneration("vectors and their space belong together")
        place = self._place(repository_id)
        os.makedirs(place, mode=0o700, exist_ok=True)
        staged = os.path.join(place, f".staged-{secrets.token_hex(8)}")
        with self._held(os.path.join(self.root, "lock")):
            os.mkdir(staged, mode=0o700)
            lease = _lease(staged, fcntl.LOCK_EX)
        try:
            with scratch(self.spark):  # the ranges go once the chunks are written
                search.with_tokens(in_order(chunks)).select([f.split()[0] for f in m.CHUNK.split(", ")]).write.parquet(_uri(f"{staged}/chunks"), compression=CODEC)
            rows = self.spark.read.schema(m.CHUNK).parquet(_uri(f"{staged}/chunks"))
            check_chunks(rows)
            if vectors is not None:
                beside(vectors, rows).write.parquet(_uri(f"{staged}/vectors"))
                unit = self.spark.read.schema(m.VECTOR).parquet(_uri(f"{staged}/vectors"))
                check_vectors(rows, unit, space.dimensions)
            stated = revision(policy, rows)
            manifest = Manifest(
                repository_id, digests.generation_id(policy, stated, space and space.fingerprint), stated, content_digest(rows), policy, space.fingerprint if space else "",
                space.model if space else "", space.dimensions if space else 0, METRIC, vector_digest(unit if vectors is not None else None))
            _write(f"{staged}/manifest.json", asdict(manifest) | {"digest": manifest.digest()})
            self._swap(place, staged, manifest, base)
            return manifest
        finally:
            os.close(lease)
            shutil.rmtree(staged, ignore_errors=True)

    def _swap(self, place: str, staged: str, manifest: Manifest, base: str | None) -> None:
        with self._held(os.path.join(self.root, "lock")):
            now = self.active(manifest.repository_id)
            if now == manifest.generation_id:
                if self._manifest(place, now) != manifest:
                    raise m.InvalidGeneration("another generation of this id is published")
                verify(self.spark, os.path.join(place, now), manifest)
                return
            if now != base:
                raise m.ConcurrentIndex("another generation was published meanwhile")
            target = os.path.join(place, manifest.generation_id)
            if os.path.isdir(target):  # of an earlier time, not published now
                old = _lease(target, fcntl.LOCK_EX)
                if old is None:
                    raise m.ConcurrentIndex("this generation is being read")
                shutil.rmtree(target)
                os.close(old)
            os.rename(staged, target)
            _write(os.path.join(place, "ACTIVE"), {"generation": manifest.generation_id})

    def purge(self, repository_id: str) -> int:
        """Remove what isn't published; how many generations. What a reader or another publisher has leased stays; a
        generation that stays for a reader makes the cleanup incomplete."""
        place, gone, read = self._place(repository_id), 0, False
        with self._held(os.path.join(self.root, "lock")):
            now = self.active(repository_id)
            for name in os.listdir(place) if os.path.isdir(place) else ():
                folder = os.path.join(place, name)
                if not os.path.isdir(folder) or name == now:
                    continue
                lease = _lease(folder, fcntl.LOCK_EX)
                if lease is None:
                    read = read or not name.startswith(".staged-")
                    continue
                try:
                    shutil.rmtree(folder)
                    gone += 1
                except OSError:
                    raise m.CleanupIncomplete("a generation can't be removed") from None
                finally:
                    os.close(lease)
        if read:
            raise m.CleanupIncomplete("readers are open")
        return gone

    def generations(self, repository_id: str) -> DataFrame:
        """(generation_id, active, chunks) of every whole generation on disk."""
        place, now = self._place(repository_id), self.active(repository_id)
        names = [n for n in sorted(os.listdir(place)) if os.path.isfile(os.path.join(place, n, "manifest.json")) and not n.startswith(".")] if os.path.isdir(place) else []
        known = self.spark.createDataFrame([(n, n == now) for n in names], "generation_id string, active boolean")
        if not names:
            return known.withColumn("chunks", F.lit(0).cast("long"))
        rows = self.spark.read.schema(m.CHUNK).parquet(*(_uri(os.path.join(place, n, "chunks")) for n in names))
        counted = rows.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("generation_id")).agg(F.count("*").alias("chunks"))
        return known.join(counted, "generation_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))

    def _manifest(self, place: str, generation: str) -> Manifest:
        value = _read(os.path.join(place, generation, "manifest.json"))
        if value is None:
            raise m.ReindexRequired("no manifest")
        stated = value.pop("digest", None)
        try:
            manifest = Manifest(**value)
            if manifest.digest() != stated or manifest.generation_id != generation:
                raise m.ReindexRequired("another manifest digest")
        except TypeError:
            raise m.ReindexRequired("another manifest format") from None
        return manifest

    def bind(self, repository_id: str, policy: str = m.SCAN_POLICY) -> BoundReader:
        """A reader of what is published now, once the rows are what the manifest states."""
        place = self._place(repository_id)
        with self._held(os.path.join(self.root, "lock")):  # so that no purge comes between the pointer and the lease
            generation = self.active(repository_id)
            if generation is None:
                raise m.NotFound("nothing is published")
            manifest = self._manifest(place, generation)
            if manifest.repository_id != repository_id or manifest.scan_policy_version != policy:
                raise m.ReindexRequired("another scan policy")
            lease = _lease(os.path.join(place, generation), fcntl.LOCK_SH)
        if lease is None:
            raise m.ConcurrentIndex("the generation is being replaced")
        reader = BoundReader(self, os.path.join(place, generation), manifest, lease)
        try:
            reader.verify()
        except BaseException:
            reader.close()
            raise
        return reader


def verify(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Everything the manifest states, against the rows of a generation's folder."""
    rows = spark.read.schema(m.CHUNK).parquet(_uri(f"{path}/chunks"))
    try:
        check_chunks(rows)
    except m.InvalidCorpus:
        raise m.ReindexRequired("the chunks were changed") from None
    n, different, least, most = rows.agg(F.count("*"), F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first()
    placed = n == different and (not n or (least, most) == (0, n - 1))
    if not placed or content_digest(rows) != manifest.content_digest or revision(manifest.scan_policy_version, rows) != manifest.corpus_revision:
        raise m.ReindexRequired("the chunks were changed")
    if manifest.space:
        vectors = spark.read.schema(m.VECTOR).parquet(_uri(f"{path}/vectors"))
        check_vectors(rows, vectors, manifest.dimensions)
        if vector_digest(vectors) != manifest.vector_digest:
            raise m.VectorIntegrity("the vectors were changed")


class BoundReader:
    """One generation, whatever is published later."""

    def __init__(self, store: Store, path: str, manifest: Manifest, lease: int):
        self.spark, self._path, self.manifest, self._lease = store.spark, path, manifest, lease
        self._chunks: DataFrame | None = None

    def __enter__(self) -> BoundReader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __del__(self) -> None:
        self._release()

    def _release(self) -> None:
        lease, self._lease = self._lease, None
        if lease is not None:
            os.close(lease)

    def close(self) -> None:
        self._release()
        if self._chunks is not None:
            self._chunks.unpersist()

    def chunks(self) -> DataFrame:
        if self._lease is None:
            raise m.InvalidQuery("the reader is closed")
        if self._chunks is None:
            self._chunks = self.stored().cache()
        return self._chunks

    def stored(self) -> DataFrame:
        """The chunks where they lie, so that filters reach the files."""
        return self.spark.read.schema(m.CHUNK).parquet(_uri(f"{self._path}/chunks"))

    def vectors(self) -> DataFrame:
        if not self.manifest.space:
            raise m.VectorUnavailable("this generation has no vectors")
        return self.spark.read.schema(m.VECTOR).parquet(_uri(f"{self._path}/vectors"))

    def describe(self) -> m.VectorSpace:
        if not self.manifest.space:
            raise m.VectorUnavailable("this generation has no vectors")
        return self.manifest.space

    def verify(self) -> None:
        verify(self.spark, self._path, self.manifest)

    def lexical(self, query: m.Query) -> DataFrame:
        self._mine(query)
        return search.lexical_search(self.chunks(), query.text, query.limit, query.filter, m.LANGUAGES, query.repository_id)

    def semantic(self, query: m.Query, vector: list[float], space: m.VectorSpace, generation: str | None = None) -> DataFrame:
        self._mine(query)
        if generation is not None and generation != self.manifest.generation_id:
            raise m.GenerationChanged("another generation is published")
        if self.describe() != space:
            raise m.IncompatibleSpace("the vectors are of another space")
        unit = search.normalize_query(vector, space.dimensions)
        if self._lease is None:
            raise m.InvalidQuery("the reader is closed")
        return search.vector_search(self.stored(), self.vectors(), unit, query.limit, query.filter, m.LANGUAGES)

    def _mine(self, query: m.Query) -> None:
        if query.repository_id != self.manifest.repository_id:
            raise m.InvalidQuery("another repository")
