import fcntl
import json
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tessera import model as m
from tessera.functions import digests
from tessera.operators import search
from tessera.plans import build, retrieve
from tessera.plans.snapshot import Snapshots
from tessera.plans.store import Manifest, Store
from tessera.sources.embedding import Batch, HashEmbedder

COLUMNS = "chunk_id string, text string, language string, symbol_name string, path string, start_line int, end_line int"
ROWS = [("c1", "def authorize_session(): pass", "python", "authorize_session", "src/security.py", 1, 2), ("c2", "def calculate_total(): pass", "python", "calculate_total", "tests/math.py", 1, 2), ("c3", "x", "python", "", "a/b.py", 1, 1), ("c4", "y", "python", "", "a.py", 1, 1)]
POLICY, REPO = m.SCAN_POLICY, "/repo"


@pytest.fixture
def corpus(spark):
    return build.Corpus(spark.createDataFrame(ROWS, COLUMNS), POLICY)


@pytest.fixture
def store(spark, tmp_path):
    root = tmp_path / "store"
    root.mkdir(mode=0o700)
    return Store.create(spark, str(root))


class Down(HashEmbedder):
    def embed(self, texts):
        raise m.SemanticUnavailable(attempts=3)


class Wrong(HashEmbedder):
    def embed(self, texts):
        return Batch(self.profile(), self.dimensions, [[0.0] * self.dimensions] * len(texts), 1)


def test_publish_bind_search_verify(store, corpus):
    with pytest.raises(m.NotFound):
        store.bind(REPO)
    done = build.build(store, REPO, corpus, "required", HashEmbedder())
    assert (done.status, done.vectors, done.requests) == ("indexed", 4, 1)
    with store.bind(REPO) as reader:
        reader.verify()
        assert [r.chunk_id for r in reader.chunks().orderBy("ordinal").collect()] == ["c3", "c4", "c1", "c2"]
        assert [r.chunk_id for r in reader.lexical(m.Query(REPO, "authorize session")).collect()] == ["c1"]
        vector = HashEmbedder().embed(["def calculate_total(): pass"]).vectors[0]
        assert reader.semantic(m.Query(REPO, "q", 1), vector, reader.describe()).first().chunk_id == "c2"
        with pytest.raises(m.IncompatibleSpace):
            reader.semantic(m.Query(REPO, "q", 1), vector, m.VectorSpace("f", "m", 64))
        with pytest.raises(m.GenerationChanged):
            reader.semantic(m.Query(REPO, "q", 1), vector, reader.describe(), "other")
        with pytest.raises(m.InvalidQuery):
            reader.lexical(m.Query("/else", "x"))
        assert store.purge(REPO) == 0
    again = build.build(store, REPO, corpus, "required", HashEmbedder())
    assert again.manifest == done.manifest and store.active(REPO) == done.manifest.generation_id
    with pytest.raises(m.InvalidQuery):
        reader.chunks()


def test_compare_and_swap_and_purge(store, corpus, spark):
    first = store.publish(REPO, corpus.chunks, POLICY, None)
    other = corpus.chunks.where("chunk_id <> 'c4'")
    with pytest.raises(m.ConcurrentIndex):
        store.publish(REPO, other, POLICY, None)
    assert store.active(REPO) == first.generation_id
    reader = store.bind(REPO)
    second = store.publish(REPO, other, POLICY, first.generation_id)
    with pytest.raises(m.CleanupIncomplete):
        store.purge(REPO)
    with store.bind(REPO) as later:
        assert reader.chunks().count() == 4 and later.chunks().count() == 3
    assert sorted(tuple(r) for r in store.generations(REPO).collect()) == sorted([(first.generation_id, False, 4), (second.generation_id, True, 3)])
    reader.close()
    assert store.purge(REPO) == 1 and store.active(REPO) == second.generation_id
    assert not [n for n in os.listdir(store._place(REPO)) if n.startswith(".staged")]


def test_leases_of_other_processes(store, corpus):
    first = store.publish(REPO, corpus.chunks, POLICY, None)
    store.publish(REPO, corpus.chunks.where("chunk_id <> 'c4'"), POLICY, first.generation_id)
    place = store._place(REPO)
    os.mkdir(os.path.join(place, ".staged-left"))
    os.mkdir(os.path.join(place, ".staged-live"))
    held = "import fcntl, os, sys\nfds = [os.open(p, os.O_RDWR | os.O_CREAT) for p in sys.argv[1::2]]\nfor fd, how in zip(fds, sys.argv[2::2]): fcntl.flock(fd, int(how))\nprint('held', flush=True)\nsys.stdin.read()"
    wanted = [os.path.join(place, first.generation_id, "lease"), str(fcntl.LOCK_SH), os.path.join(place, ".staged-live", "lease"), str(fcntl.LOCK_EX)]
    with subprocess.Popen([sys.executable, "-c", held, *wanted], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as other:
        assert other.stdout.readline() == b"held\n"
        with pytest.raises(m.CleanupIncomplete):
            store.purge(REPO)
        assert {".staged-live", first.generation_id} <= set(os.listdir(place)) and ".staged-left" not in os.listdir(place)
    assert store.purge(REPO) == 2


def test_hits_are_checked():
    good = {"chunk_id": "c", "text": "t", "path": "a/b.py", "start_line": 1, "end_line": 2, "score": 0.5}
    assert search.validated([good]) == [good]
    for bad in ([good, good], [good | {"chunk_id": ""}], [good | {"text": None}], [good | {"path": "../b"}], [good | {"start_line": 3}], [good | {"score": float("nan")}], [good | {"score": float("inf")}]):
        with pytest.raises(m.EvidenceIntegrity):
            search.validated(bad)


class Slow(HashEmbedder):
    def embed(self, texts):
        time.sleep(1)
        return super().embed(texts)


def test_modes(store, corpus):
    first = build.build(store, REPO, corpus)
    with pytest.raises(m.SemanticUnavailable):
        build.build(store, REPO, corpus, "required", Down())
    for mode in ("preferred", "required"):
        with pytest.raises(m.VectorIntegrity):
            build.build(store, REPO, corpus, mode, Wrong())
    assert store.active(REPO) == first.manifest.generation_id
    done = build.build(store, REPO, corpus, "preferred", Down())
    assert done.status == "degraded" and done.manifest.space is None
    for bad in (("loud", None), ("required", None)):
        with pytest.raises(m.InvalidConfig):
            build.build(store, REPO, corpus, *bad)
    with pytest.raises(m.CostLimit):
        build.check_cost(corpus.chunks, most_chunks=3)
    with pytest.raises(m.CostLimit):
        build.check_cost(corpus.chunks, most_bytes=3)


def test_hybrid_and_fallback(store, corpus):
    build.build(store, REPO, corpus, "required", HashEmbedder())
    events = []
    with store.bind(REPO) as reader:
        query = m.Query(REPO, "def calculate_total(): pass", 2)
        answer = retrieve.retrieve(reader, query, "preferred", HashEmbedder(), 60, observer=events.append)
        assert answer.mode == "hybrid" and answer.hits.first().chunk_id == "c2" and answer.hits.first().score == 1.0
        answer = retrieve.retrieve(reader, query, "preferred", Down(), observer=events.append)
        lexical = reader.lexical(query).collect()
        assert answer.mode == "fallback" and [(r.chunk_id, r.score) for r in answer.hits.collect()] == [(r.chunk_id, r.score) for r in lexical]
        assert [(e.backend, e.kind, e.reason) for e in events] == [("lexical", "ok", ""), ("vector", "ok", ""), ("lexical", "ok", ""), ("vector", "degraded", "SemanticUnavailable")]
        with pytest.raises(m.SemanticUnavailable):
            retrieve.retrieve(reader, query, "required", Down())
        assert retrieve.retrieve(reader, query, "preferred", Slow(), 0.01).mode == "fallback"
        with pytest.raises(m.SemanticUnavailable):
            retrieve.retrieve(reader, query, "required", Slow(), 0.01)
        with pytest.raises(m.IncompatibleSpace):
            retrieve.retrieve(reader, query, "required", HashEmbedder(32))
        assert retrieve.retrieve(reader, query).mode == "lexical"
        for bad in (dict(mode="x"), dict(mode="required"), dict(mode="required", embedder=Down(), deadline_s=301)):
            with pytest.raises(m.InvalidConfig):
                retrieve.retrieve(reader, query, **bad)


def test_tampering_is_found(store, corpus, spark):
    done = build.build(store, REPO, corpus, "required", HashEmbedder())
    place = os.path.join(store._place(REPO), done.manifest.generation_id)
    rows = spark.read.parquet(f"{place}/chunks").withColumn("text", F.concat("text", F.lit("!"))).collect()
    chunks = spark.createDataFrame(rows, m.CHUNK)
    chunks.write.mode("overwrite").parquet(f"{place}/chunks")
    with pytest.raises(m.ReindexRequired):
        store.bind(REPO).verify()
    file = os.path.join(place, "manifest.json")
    value = json.load(open(file))
    json.dump(value | {"profile_model": "other"}, open(file, "w"))
    with pytest.raises(m.ReindexRequired):
        store.bind(REPO)


def test_invalid_rows(store, spark):
    for row in (("c1", "", "python", "", "a.py", 1, 1), ("c1", "x", "python", "", "../a.py", 1, 1), ("c1", "x", "python", "", "a.py", 2, 1)):
        with pytest.raises(m.InvalidCorpus):
            store.publish(REPO, spark.createDataFrame([row], COLUMNS), POLICY, None)
    with pytest.raises(m.InvalidCorpus):
        store.publish(REPO, spark.createDataFrame([ROWS[0], ROWS[0]], COLUMNS), POLICY, None)
    one = spark.createDataFrame([ROWS[0]], COLUMNS)
    vectors = spark.createDataFrame([("else", [1.0, 0.0])], "chunk_id string, values array<float>")
    with pytest.raises(m.VectorIntegrity):
        store.publish(REPO, one, POLICY, None, vectors, m.VectorSpace("f", "m", 2))
    assert store.active(REPO) is None


def test_opening_never_makes(spark, tmp_path, store):
    with pytest.raises(m.NotFound):
        Store.open(spark, str(tmp_path / "none"))
    os.chmod(store.root, 0o755)
    with pytest.raises(m.InvalidRepository):
        Store.open(spark, store.root)
    os.chmod(store.root, 0o700)
    assert Store.open(spark, store.root).identity == Store.create(spark, store.root).identity
    with open(os.path.join(store.root, "store.json"), "w") as f:
        json.dump({"format": 1, "id": "x" * 64}, f)
    with pytest.raises(m.ReindexRequired):
        Store.open(spark, store.root)


def test_manifest_rules():
    good = Manifest("r", "g", "a" * 64, "b" * 64, "p", "f", "m", 3, "cosine", "c" * 64)
    assert good.digest() != Manifest("r", "g", "a" * 64, "b" * 64, "p", "", "", 0, "cosine", "c" * 64).digest()
    for bad in (dict(dimensions=0), dict(profile_model=""), dict(metric="dot"), dict(content_digest="B" * 64), dict(repository_id=" ")):
        with pytest.raises(m.InvalidGeneration):
            Manifest(**(good.__dict__ | bad)).digest()


def test_snapshots(spark, tmp_path, corpus):
    snapshots = Snapshots(spark, str(tmp_path / "s"), make=True)
    with pytest.raises(m.NotFound):
        snapshots.load(REPO)
    revision = snapshots.replace(REPO, corpus.chunks, POLICY)
    chunks, again = snapshots.load(REPO)
    assert chunks.count() == 4 and again == revision == digests.revision_of(POLICY, ["c1", "c2", "c3", "c4"])
    with pytest.raises(m.ReindexRequired):
        snapshots.load(REPO, "scanner-v5")
    with pytest.raises(m.InvalidChunk):
        snapshots.replace(REPO, corpus.chunks.withColumn("text", F.lit("")), POLICY)
    path = snapshots._path(REPO)
    data = open(path).read()
    open(path, "w").write(data.replace('"c1"', '"c9"'))
    with pytest.raises(m.ReindexRequired):
        snapshots.load(REPO)


def test_a_snapshot_larger_than_one_file_may_be(spark, tmp_path, corpus, monkeypatch):
    from tessera.plans import snapshot
    from tessera.plans.store import walk

    monkeypatch.setattr(snapshot, "MAX_BYTES", 4096)
    snapshots = Snapshots(spark, str(tmp_path / "s"), make=True)
    texts = corpus.chunks.withColumn("text", F.concat("text", F.repeat(F.lit(" word"), 2000)))
    revision = snapshots.replace(REPO, texts, POLICY)
    before, again = snapshots.load(REPO)
    wanted = sorted(map(tuple, texts.select("chunk_id", "text").collect()))
    assert again == revision and sorted(map(tuple, before.select("chunk_id", "text").collect())) == wanted
    assert [r["chunk_id"] for r in before.orderBy("ordinal").collect()] == [r["chunk_id"] for r in texts.orderBy(*walk()).collect()]
    folders = lambda: [x for x in os.listdir(snapshots.root) if os.path.isdir(os.path.join(snapshots.root, x))]
    snapshots.replace(REPO, texts.where("chunk_id <> 'c1'"), POLICY)
    assert before.count() == 4 and snapshots.load(REPO)[0].count() == 3  # what was loaded before can still be read
    snapshots.replace(REPO, texts, POLICY)
    with pytest.raises(m.InvalidChunk):
        snapshots.replace(REPO, texts.withColumn("chunk_id", F.lit("c1")), POLICY)
    assert len(folders()) == 2 and snapshots.load(REPO)[1] == revision
    place = os.path.join(snapshots.root, snapshots._head(REPO)["folder"], "chunks")
    changed = spark.createDataFrame(spark.read.parquet(place).withColumn("text", F.concat("text", F.lit("!"))).collect(), snapshot._STORED)
    changed.write.mode("overwrite").parquet(place)
    with pytest.raises(m.ReindexRequired):
        snapshots.load(REPO)


def test_rollback(spark, tmp_path, store, corpus):
    snapshots = Snapshots(spark, str(tmp_path / "s"), make=True)
    done = build.build(store, REPO, corpus)
    with pytest.raises(m.NotFound):
        snapshots.rollback(REPO, done.manifest)
    revision = snapshots.replace(REPO, corpus.chunks, POLICY)
    snapshots.mark(REPO, POLICY, revision, done.manifest.generation_id)
    assert snapshots.rollback(REPO, done.manifest).count() == 4
    snapshots.mark(REPO, POLICY, revision, "other")
    with pytest.raises(m.ReindexRequired):
        snapshots.rollback(REPO, done.manifest)
    snapshots.replace(REPO, corpus.chunks, POLICY)
    with pytest.raises(m.NotFound):
        snapshots.marker(REPO)


def test_a_rollback_larger_than_one_file_may_be(spark, tmp_path, store, corpus, monkeypatch):
    from tessera.plans import snapshot

    monkeypatch.setattr(snapshot, "MAX_BYTES", 4096)
    texts = corpus.chunks.withColumn("text", F.concat("text", F.repeat(F.lit(" word"), 2000)))
    done = store.publish(REPO, texts, POLICY, None)
    snapshots = Snapshots(spark, str(tmp_path / "s"), make=True)
    snapshots.mark(REPO, POLICY, snapshots.replace(REPO, texts, POLICY), done.generation_id)
    rows = snapshots.rollback(REPO, done)
    assert sorted(map(tuple, rows.select("chunk_id", "text").collect())) == sorted(map(tuple, texts.select("chunk_id", "text").collect()))


def test_digests_in_plans_equal_the_drivers(spark):
    ids = ["b", "é", "a", "Z"]
    df = spark.createDataFrame([(ids, "x", "éy")], "ids array<string>, a string, b string")
    row = df.select(digests.corpus_revision("p", F.col("ids")).alias("r"), digests.framed_column([F.col("a"), F.col("b")]).alias("f")).first()
    assert row.r == digests.revision_of("p", sorted(ids, key=str.encode)) and row.f == digests.framed(["x", "éy"])
    assert digests.generation_id("p", "r") != digests.generation_id("p", "r", "f")
