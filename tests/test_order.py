"""Places, digests and vector search of tables that no single task or driver sees whole."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import digests
from tessera.operators import merkle, ordinals, search
from tessera.plans import store

CHUNKS = "chunk_id string, text string, language string, symbol_name string, path string, start_line int, end_line int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(n, seed=1):
    """Paths with shared prefixes, folders beside files of their name, and chunks that tie but for their ids."""
    rng = random.Random(seed)
    names = ["a", "a.py", "a-b", "ab", "b", "a/b", "a/b.py", "a/b/c", "A", "é"]
    return [(f"c{i:04d}", "t", "python", "", rng.choice(names) + "/" + rng.choice(names), rng.randrange(1, 4), 9) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ordinals_are_those_of_a_walk(spark, parts):
    rows = rows_of(500)
    walked = [r[0] for r in sorted(rows, key=lambda r: ([p.encode() for p in r[4].split("/")], r[5], r[0]))]
    found = ordinals.numbered(spark.createDataFrame(rows, CHUNKS).repartition(7), *store.walk(), name="ordinal", parts=parts)
    assert [r.chunk_id for r in sorted(found.collect(), key=lambda r: r.ordinal)] == walked
    assert sorted(r.ordinal for r in found.collect()) == [*range(500)]
    assert "Window" not in plan(found) and found.columns == [*CHUNKS.replace(" string", "").replace(" int", "").split(", "), "ordinal"]


def test_ties_and_empty_tables_are_numbered(spark):
    found = ordinals.numbered(spark.createDataFrame([(1,), (1,), (None,), (None,), (0,)], "x int"), F.asc_nulls_last("x"), name="n")
    assert sorted((r.n, r.x) for r in found.collect())[:1] == [(0, 0)] and sorted(r.n for r in found.collect()) == [0, 1, 2, 3, 4]
    assert {r.n for r in found.collect() if r.x is None} == {3, 4}
    assert ordinals.numbered(spark.createDataFrame([], "x int"), "x", name="n").collect() == []


def tree(leaves, tag, fan, levels):
    level = [(d, 1) for d in leaves]
    for _ in range(levels):
        level = [(hashlib.sha256(b"".join(bytes.fromhex(d) for d, _ in level[i : i + fan])).hexdigest(), sum(n for _, n in level[i : i + fan])) for i in range(0, len(level), fan)]
    out = hashlib.sha256()
    for part in (tag.encode(), sum(n for _, n in level).to_bytes(8, "big"), *(d.encode() for d, _ in level)):
        out.update(struct.pack(">Q", len(part)) + part)
    return out.hexdigest()


@pytest.mark.parametrize("n,fan,levels", [(0, 4, 2), (1, 4, 2), (37, 4, 2), (64, 4, 3), (1000, 7, 3)])
def test_a_tree_of_hashes_however_rows_are_partitioned(spark, n, fan, levels):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    rows = spark.createDataFrame([*enumerate(leaves)], "at long, leaf string")
    for parts in (1, 5):
        assert merkle.tree_digest(rows.repartition(parts), F.col("at"), F.col("leaf"), "t", fan, levels) == tree(leaves, "t", fan, levels)
    if n > 1:
        changed = [leaves[1], leaves[0], *leaves[2:]]
        other = spark.createDataFrame([*enumerate(changed)], "at long, leaf string")
        assert merkle.tree_digest(other, F.col("at"), F.col("leaf"), "t", fan, levels) != tree(leaves, "t", fan, levels)
    top = merkle.nodes(rows.select("at", F.col("leaf").alias("d")), fan, levels)
    assert top.count() == -(-n // fan**levels)


def test_digests_of_chunks_tell_any_change(spark):
    rows = rows_of(300)
    chunks = lambda own, parts=4: store.in_order(spark.createDataFrame(own, CHUNKS).repartition(parts))
    plain = store.content_digest(chunks(rows))
    assert plain == store.content_digest(chunks(rows[::-1], 9))
    assert plain != store.content_digest(chunks([*rows[:-1], (*rows[-1][:1], "u", *rows[-1][2:])]))
    assert plain != store.content_digest(chunks(rows[:-1]))
    swapped = chunks(rows).withColumn("ordinal", F.when(F.col("ordinal") == 3, 4).when(F.col("ordinal") == 4, 3).otherwise(F.col("ordinal")))
    assert plain != store.content_digest(swapped)


def test_digests_of_vectors_tell_any_change(spark):
    rows = [(f"c{i}", i, f"p/{i}.py", 1, 2, "python", 1, 2, [0.6, 0.8]) for i in range(20)]
    from tessera.model import VECTOR

    digest = lambda own, parts=3: store.vector_digest(spark.createDataFrame(own, VECTOR).repartition(parts))
    plain = digest(rows)
    assert plain == digest(rows[::-1], 8)
    for i, value in ((0, "d"), (2, "q.py"), (5, "typescript"), (8, [0.6, 0.8000001]), (8, [0.8, 0.6])):
        assert plain != digest([*rows[:-1], (*rows[-1][:i], value, *rows[-1][i + 1 :])])
    assert store.vector_digest(None) != plain


def test_a_sorted_list_is_hashed_in_pieces(spark, monkeypatch):
    ids = [f"id-{i}-é" for i in range(200)]
    want = digests.revision_of("p", sorted(ids, key=str.encode))
    monkeypatch.setattr(merkle, "PIECE", 7)
    found = spark.createDataFrame([(i,) for i in ids], "chunk_id string").repartition(5)
    assert merkle.of_sorted(found, "chunk_id", digests.revision_head("p")) == want
    assert merkle.of_sorted(found.limit(0), "chunk_id", digests.revision_head("p")) == digests.revision_of("p", [])


def placed(spark, n=400, dims=3):
    rng = random.Random(2)
    chunks = spark.createDataFrame([(f"c{i}", i, f"text {i}", "python" if i % 3 else "typescript", "", f"{'src' if i % 2 else 'lib'}/f{i}.py", 1, 1) for i in range(n)], "chunk_id string, ordinal int, text string, language string, symbol_name string, path string, start_line int, end_line int")
    vectors = spark.createDataFrame([(f"c{i}", [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(n)], "chunk_id string, values array<float>")
    return chunks, vectors


@pytest.mark.parametrize("dims,limit", [(3, 10), (200, 10), (3, 300)])
def test_vectors_beside_their_keys_give_the_same_hits(spark, tmp_path, dims, limit):
    chunks, vectors = placed(spark, dims=dims)
    store.beside(vectors, chunks).write.parquet(str(tmp_path / "v"))
    chunks.repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal").write.parquet(str(tmp_path / "c"))
    both = spark.read.parquet(str(tmp_path / "v"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    query = search.normalize_query([1.0, -0.5, 0.25] + [0.01] * (dims - 3))
    vectors.select("chunk_id", search.normalized(F.col("values")).alias("values")).write.parquet(str(tmp_path / "u"))
    unit = spark.read.parquet(str(tmp_path / "u"))
    for wanted in (search.Filter(), search.Filter(path_prefixes=("src",)), search.Filter(languages=("typescript",))):
        one = search.vector_search(chunks, both, query, limit, wanted).collect()
        two = search.vector_search(chunks, unit, query, limit, wanted).collect()
        assert one == two and len(one) > 5 and one[0].text


def test_a_search_of_stored_vectors_is_one_scan(spark, tmp_path):
    chunks, vectors = placed(spark)
    store.beside(vectors, chunks).write.parquet(str(tmp_path / "v"))
    both = spark.read.parquet(str(tmp_path / "v"))
    keys = chunks.select("chunk_id", "path", "start_line", "end_line", "language")
    found = plan(search.vector_candidates(keys, both, [1.0, 0.0, 0.0], 5, search.Filter(path_prefixes=("src",), languages=("python",))))
    assert "TakeOrderedAndProject" in found and "Exchange" not in found and "Join" not in found
    assert "StringStartsWith(path,src/)" in found and "PushedFilters" in found and found.count("Scan parquet") == 1


def test_texts_of_the_best_are_read_by_their_ordinals(spark, tmp_path):
    chunks, vectors = placed(spark)
    store.beside(vectors, chunks).write.parquet(str(tmp_path / "v"))
    chunks.write.parquet(str(tmp_path / "c"))
    found = search.vector_candidates(spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "v")), [1.0, 0.0, 0.0], 2)
    assert "EqualTo(ordinal," in plan(found) and found.count() == 2
