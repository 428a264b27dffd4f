import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tessera import model as m
from tessera.plans import build
from tessera.sources import embedding
from tessera.sources.embedding import Batch, HashEmbedder, HttpEmbedder, ProviderConfig, checked_batch, unit


@pytest.fixture
def provider():
    """A provider on loopback. Its plan is a list of (status, change); the last one stays."""
    seen, plan = [], [(200, None)]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            status, change = plan.pop(0) if len(plan) > 1 else plan[0]
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            root = {"data": list(reversed(data)), "usage": {"total_tokens": len(data)}}
            out = json.dumps(change(root) if change else root).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", seen, plan
    server.shutdown()


def client(url, **settings):
    return HttpEmbedder(ProviderConfig(url, "model", **settings), sleep=lambda s: None)


def test_order_batches_and_tokens(provider):
    url, seen, _ = provider
    texts = ["x" * (i + 1) for i in range(70)]
    batch = client(url, api_key="k").embed(texts)
    assert len(seen) == batch.requests == 3 and batch.usage_tokens == 70 and {s[2] for s in seen} == {"Bearer k"}
    assert batch.vectors == [unit([len(t), 1.0]) for t in texts] and sorted(len(s[1]["input"]) for s in seen) == [6, 32, 32]
    checked_batch(batch, 70, client(url).profile())
    small = client(url, batch_bytes=200)
    assert all(len(b) <= 200 for _, b in small.batches(["é" * 20] * 9))
    with pytest.raises(m.InvalidBatch):
        small.batches(["x" * 300])


def test_retries(provider):
    url, seen, plan = provider
    plan[:] = [(503, None), (429, None), (200, None)]
    assert client(url).embed(["a"]).requests == 3
    plan[:] = [(500, None)]
    with pytest.raises(m.SemanticUnavailable) as e:
        client(url).embed(["a"])
    assert e.value.attempts == 3
    seen.clear()
    plan[:] = [(401, None)]
    with pytest.raises(m.SemanticUnavailable):
        client(url).embed(["a"])
    assert len(seen) == 1


@pytest.mark.parametrize("change", [lambda r: {}, lambda r: r | {"data": r["data"][1:]}, lambda r: r | {"data": r["data"][:1] * 2}, lambda r: [], lambda r: r | {"data": [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0, 2.0]}]}])
def test_malformed_answers(provider, change):
    url, _, plan = provider
    plan[:] = [(200, change)]
    with pytest.raises(m.InvalidBatch):
        client(url).embed(["a", "b"])


def test_zero_vectors(provider):
    url, _, plan = provider
    plan[:] = [(200, lambda r: r | {"data": [{"index": 0, "embedding": [0.0, 0.0]}]})]
    with pytest.raises(m.InvalidVector):
        client(url).embed(["a"])


@pytest.mark.parametrize("url", ["http://example.com/v1", "ftp://127.0.0.1/v1", "https://u:p@example.com/v1", "https://example.com/v2", "https://example.com/v1?x=1", "https://example.com/v1#x", "http://localhost/v1", "https:///v1", "http://127.0.0.1:x/v1"])
def test_urls(url):
    with pytest.raises(m.InvalidConfig):
        ProviderConfig(url, "m")


def test_profiles():
    a, b = ProviderConfig("https://example.com/v1", "m"), ProviderConfig("https://example.com/v1/", "m", api_key="secret")
    assert a.fingerprint == b.fingerprint != ProviderConfig("https://example.com/v1", "m", 8).fingerprint and "secret" not in repr(b)
    assert not a.local and ProviderConfig("http://[::1]:80/v1", "m").local
    for bad in (dict(batch_items=129), dict(in_flight=9), dict(timeout_s=0), dict(dimensions=-1)):
        with pytest.raises(m.InvalidConfig):
            ProviderConfig("https://example.com/v1", "m", **bad)


def test_batches_are_checked():
    e = HashEmbedder(8)
    good = e.embed(["a", ""])
    assert checked_batch(good, 2, e.profile()) is good
    for bad in (Batch(e.profile(), 8, good.vectors[:1], 1), Batch(e.profile(), 8, good.vectors, 0), Batch(HashEmbedder(4).profile(), 8, good.vectors, 1)):
        with pytest.raises(m.InvalidBatch):
            checked_batch(bad, 2, e.profile())
    for v in ([0.0] * 8, [float("nan")] * 8, [1.0]):
        with pytest.raises(m.InvalidVector):
            checked_batch(Batch(e.profile(), 8, [v, v], 1), 2, e.profile())


def rows_of(spark, n):
    return spark.createDataFrame([(f"c{i:03}", "x" * (i + 1)) for i in range(n)], "chunk_id string, text string").repartition(5)


def remote(url, **settings):
    return HttpEmbedder(ProviderConfig(url, "model", **settings))


def test_a_table_is_embedded_by_tasks(spark, provider, monkeypatch):
    url, seen, plan = provider
    plan[:] = [(503, None), (200, None), (429, None), (200, None)]
    vectors, space, requests, tokens = build.embed_chunks(rows_of(spark, 150), remote(url, batch_items=8), clients=3)
    got = {r.chunk_id: list(r["values"]) for r in vectors.collect()}
    assert got == {f"c{i:03}": unit([i + 1.0, 1.0]) for i in range(150)}  # each id has its own text's vector
    sent = sorted(t for _, body, _ in seen for t in body["input"])
    assert space.dimensions == 2 and tokens == 150 and requests == len(seen) and len(sent) - 150 in (8, 16) and max(len(body["input"]) for _, body, _ in seen) == 8


def test_rounds_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(embedding, "ROUND_ITEMS", 7)
    batches = rows_of(spark, 40).toArrow().to_batches()
    assert [len(ids) for ids, _ in embedding._rounds(iter(batches))] == [7, 7, 7, 7, 7, 5]
    monkeypatch.setattr(embedding, "ROUND_BYTES", 100)
    assert all(sum(map(len, texts)) <= 100 or len(texts) == 1 for _, texts in embedding._rounds(iter(batches)))


def test_failures_of_tasks_are_told_once(spark, provider):
    url, seen, plan = provider
    plan[:] = [(401, None)]
    with pytest.raises(m.SemanticUnavailable) as e:
        build.embed_chunks(rows_of(spark, 20), remote(url), clients=2)
    assert e.value.attempts == 1 and len(seen) <= 2  # a task's failure isn't tried again
    plan[:] = [(200, lambda r: r | {"data": r["data"][1:]})]
    with pytest.raises(m.InvalidBatch):
        build.embed_chunks(rows_of(spark, 20), remote(url), clients=2)
    plan[:] = [(200, lambda r: r | {"data": [d | {"embedding": [0.0, 0.0]} for d in r["data"]]})]
    with pytest.raises(m.VectorIntegrity):
        build.embed_chunks(rows_of(spark, 20), remote(url), clients=2)
    plan[:] = [(200, None), (200, lambda r: r | {"data": [d | {"embedding": [1.0]} for d in r["data"]]})]
    with pytest.raises(m.InvalidBatch):
        build.embed_chunks(rows_of(spark, 20), remote(url), clients=2)


def test_the_first_failure_stops_the_others(provider):
    """A request that fails late in the list isn't waited for behind those before it."""
    url, seen, plan = provider
    plan[:] = [(401, None), (200, None)]
    with pytest.raises(m.SemanticUnavailable):
        client(url, batch_items=1).embed(["x"] * 60)
    assert len(seen) < 30


def test_texts_without_a_direction_have_no_row(spark, tmp_path):
    """They get a vector that stands in, which the query tells from one of their own, as its SQL does."""
    import duckdb

    from tessera import queries_store as q
    from tessera.queries import ORACLES, QUERIES

    place = lambda w: (int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big") % q.DIMS, hashlib.sha256(w.encode()).digest()[0] >> 7)
    words = {}
    for i in range(2000):
        words.setdefault(place(f"w{i}"), f"w{i}")
    texts = [f"{words[5, 0]} {words[5, 1]}", words[0, 1], " \n\u2003", "", "\u0391\u03a3 \u0130stanbul", "the cat"]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(f"SELECT chunk_id, n, first, last FROM ({ORACLES['embed_corpus']})").fetchall()
    got = QUERIES["embed_corpus"](spark, str(tmp_path)).select("chunk_id", "n", "first", "last").collect()
    assert sorted(map(tuple, got)) == sorted(want) and [r[0] for r in sorted(want)] == ["1", "4", "5"]
    assert HashEmbedder(q.DIMS).embed(texts).stand_ins == {0, 2, 3}
