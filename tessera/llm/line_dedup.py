"""Line dedup with a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys found in at
least ``min_docs`` documents lose all their lines everywhere.

1. Each document sends the 128-bit hashes of its distinct keys; they are counted with partial sums.
2. The hashes found in two documents or more are dealt into shards of bounded size. (A hash of one
   document can't reach a threshold of two; the fingerprints reject it.) Each shard becomes a
   minimal perfect hash with an array of 64-bit fingerprints and an array of counts.
3. Documents probe these arrays. Their measured size decides how: up to ``broadcast_mb`` they are
   broadcast and texts never move; beyond it documents are dealt into chunks, the distinct hashes of a chunk go to
   their shards, and the hits come back to the chunk. A line in every document is one row a chunk there. Both ways
   give the same rows.

Defined cases: a null or empty text is one empty line, which has no key and stays; repeated rows
and repeated ids count as documents of their own; a null ``doc_id`` is a value like others; lines of one key tie and go
or stay together; very long texts are split and probed whole; an empty table gives an empty result; other columns pass
through untouched, whatever their names (but for n_lines and n_dropped, which are replaced).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import ASCII_LOWER, as_bytes, batch, fresh, runs
from tessera.session import small_batches, stored

#: Distinct hashes a shard holds, about.
SHARD_KEYS = 1 << 17
#: A task's hashes are sent on when it holds this many.
FLUSH = 100_000
#: Documents of a chunk, as a power of two.
CHUNK_BITS = 10
_GAMMA = 2


def line_key(line: bytes) -> bytes:
    return line.strip().translate(ASCII_LOWER)


def key_hash(key: bytes) -> bytes:
    """16 bytes: two 64-bit halves, the first places the key, the second is its fingerprint."""
    return xxhash.xxh3_128_digest(key)


# --- minimal perfect hash -------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (_mix(a ^ _mix(b + salt)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bit arrays: a key sits in the first level where no other key took its slot."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        self.ranks, base = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> PerfectHash:
        """a, b: the halves of distinct 128-bit hashes."""
        levels, left = [], np.arange(len(a))
        while len(left):
            size = max(64, -(-_GAMMA * len(left) // 64) * 64)
            at = _slot(a[left], b[left], len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            words = np.zeros(size // 64, np.uint64)
            np.bitwise_or.at(words, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            levels.append(words)
            left = left[~alone]
        out = cls(levels, np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint32))
        slot = out._index(a, b)
        out.prints[slot], out.counts[slot] = b, np.minimum(counts, 0xFFFFFFFF)
        return out

    def _index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            at = _slot(a[left], b[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[found]] = (self.ranks[level][at >> 6] + below)[found]
            left = left[~found]
        return out

    def count(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The counts of hashes; 0 for those that the table doesn't hold."""
        at = self._index(a, b)
        if not len(self.prints):
            return np.zeros(len(a), np.uint32)
        known = (at >= 0) & (self.prints[at] == b)
        return np.where(known, self.counts[at], 0).astype(np.uint32)

    def dump(self) -> bytes:
        head = np.array([len(self.levels), len(self.prints), *map(len, self.levels)], np.int64)
        return b"".join(x.tobytes() for x in (head, *self.levels, self.prints, self.counts))

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n_levels, n_keys = np.frombuffer(blob, np.int64, 2)
        sizes = np.frombuffer(blob, np.int64, int(n_levels), 16)
        at, levels = 16 + 8 * int(n_levels), []
        for n in sizes:
            levels.append(np.frombuffer(blob, np.uint64, int(n), at))
            at += 8 * int(n)
        return cls(levels, np.frombuffer(blob, np.uint64, int(n_keys), at), np.frombuffer(blob, np.uint32, int(n_keys), at + 8 * int(n_keys)))


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


# --- counting and building -----------------------------------------------------------------


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])


def _doc_keys(text: bytes | None, min_chars: int) -> list[bytes]:
    """Per line its key's hash, or b"" for a line that can't be dropped."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line_key(line)
        fits = len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(key_hash(key) if key and fits else b"")
    return out


def _counted(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            a, b = _halves(list(seen))
            out = batch(["h1", "h2", "n"], [a.view(np.int64), b.view(np.int64), np.fromiter(seen.values(), np.int64, len(seen))])
            seen.clear()
            return out

        for rows in batches:
            for text in as_bytes(rows["text"]):
                seen.update({h for h in _doc_keys(text, min_chars) if h})
                if len(seen) >= FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return run


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): in how many documents each distinct line key stands."""
    small_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(_counted(min_chars), "h1 long, h2 long, n long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _shard_column(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("h1", 20), F.lit(shards)).cast("int")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard -> a perfect hash per shard; one shard is held at a time."""
    for shard, parts in runs(batches, "shard"):
        held = pa.Table.from_batches(list(parts))
        a, b = (held[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        table = PerfectHash.build(a, b, held["n"].to_numpy())
        yield batch(["shard", "n_keys", "blob"], [pa.array([shard], pa.int32()), pa.array([len(a)], pa.int64()), pa.array([table.dump()], pa.binary())])


def build_index(docs: DataFrame, min_chars: int = 1, least: int = 2) -> tuple[DataFrame, int]:
    """(shard, n_keys, blob) rows in the shared folder, and the number of shards."""
    counts = stored(line_counts(docs, min_chars).where(F.col("n") >= least), "line-counts")
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    dealt = counts.withColumn("shard", _shard_column(shards)).repartition("shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(_built, "shard int, n_keys long, blob binary"), "line-index"), shards


# --- probing -----------------------------------------------------------------------------


def _rewritten(text: bytes | None, keys: list[bytes], dropped: list[bool]) -> tuple[bytes | None, int, int]:
    n = sum(dropped)
    if not n:
        return text, len(keys), 0
    return b"\n".join(x for x, gone in zip(text.split(b"\n"), dropped) if not gone), len(keys), n


def _emit(rows: pa.RecordBatch, names: list[str], texts: list, done: list[tuple]) -> pa.RecordBatch:
    arrays = [rows[c] if c != "text" else pa.array([x[0] for x in done], pa.binary()).cast(pa.string()) for c in names]
    return batch([*names, "n_lines", "n_dropped"], [*arrays, pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())])


def _probe(names: list[str], blobs, shards: int, min_docs: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {shard: PerfectHash.load(blob) for shard, blob in blobs.value}
        for rows in batches:
            texts = as_bytes(rows["text"])
            keys = [_doc_keys(t, min_chars) for t in texts]
            flat = list({h for ks in keys for h in ks if h})
            frequent: set[bytes] = set()
            if flat and tables:
                a, b = _halves(flat)
                owner = shard_of(a, shards)
                for shard in np.unique(owner):
                    if shard in tables:
                        mine = np.flatnonzero(owner == shard)
                        hit = mine[tables[shard].count(a[mine], b[mine]) >= min_docs]
                        frequent.update(flat[i] for i in hit)
            yield _emit(rows, names, texts, [_rewritten(t, ks, [h in frequent for h in ks]) for t, ks in zip(texts, keys)])

    return run


def _chunk_hashes(min_chars: int):
    """(chunk, h1, h2) of the distinct hashes of each chunk; a chunk with very many may repeat some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        own = None

        def flush() -> pa.RecordBatch:
            a, b = _halves(list(seen))
            seen.clear()
            return batch(["chunk", "h1", "h2"], [np.full(len(a), own), a.view(np.int64), b.view(np.int64)])

        for rows in batches:
            for chunk, text in zip(rows["chunk"].to_pylist(), as_bytes(rows["text"])):
                if seen and (chunk != own or len(seen) >= FLUSH):
                    yield flush()
                own = chunk
                seen.update(_doc_keys(text, min_chars))
                seen.discard(b"")
        if seen:
            yield flush()

    return run


def _shard_probe(min_docs: int):
    """Rows sorted by shard, the shard's table before its hashes -> (chunk, h1, h2) of hashes found often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs(batches, "shard"):
            table = None
            for rows in parts:
                if rows["blob"][0].is_valid:
                    table, rows = PerfectHash.load(rows["blob"][0].as_py()), rows.slice(1)
                if table is None or not rows.num_rows:
                    continue
                a, b = (rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
                yield rows.select(["chunk", "h1", "h2"]).filter(pa.array(table.count(a, b) >= min_docs))

    return run


def _chunk_apply(chunk: str, h1: str, h2: str, names: list[str], min_chars: int):
    """Rows sorted by chunk, its hits before its documents -> documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs(batches, chunk):
            gone: set[bytes] = set()
            for rows in parts:
                hit = rows[h1].is_valid()
                some = rows.filter(hit)
                halves = np.stack([some[h].to_numpy() for h in (h1, h2)], axis=1)
                raw = np.ascontiguousarray(halves).tobytes()
                gone.update(raw[at : at + 16] for at in range(0, len(raw), 16))
                docs = rows.filter(pa.compute.invert(hit))
                if docs.num_rows:
                    texts = as_bytes(docs["text"])
                    yield _emit(docs, names, texts, [_rewritten(t, ks, [h in gone for h in ks]) for t in texts for ks in [_doc_keys(t, min_chars)]])

    return run


def _routed(docs: DataFrame, index: DataFrame, shards: int, min_docs: int, min_chars: int, schema: T.StructType) -> DataFrame:
    """``docs`` rewritten by hits that come from the shards chunk by chunk."""
    chunk, h1, h2 = fresh(docs.columns, "chunk", "h1", "h2")
    held = stored(docs.withColumn(chunk, F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "line-documents")
    keys = held.select(F.col(chunk).alias("chunk"), "text").mapInArrow(_chunk_hashes(min_chars), "chunk long, h1 long, h2 long")
    keys = keys.select(_shard_column(shards).alias("shard"), "chunk", "h1", "h2", F.lit(None).cast("binary").alias("blob"))
    none = F.lit(None).cast("long")
    both = index.select("shard", none.alias("chunk"), none.alias("h1"), none.alias("h2"), "blob").union(keys)
    both = both.repartition("shard").sortWithinPartitions("shard", F.col("chunk").asc_nulls_first())
    hits = both.mapInArrow(_shard_probe(min_docs), "chunk long, h1 long, h2 long")
    dealt = held.withColumns({h1: none, h2: none})
    back = hits.select(*(F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns), F.col("chunk").alias(chunk), F.col("h1").alias(h1), F.col("h2").alias(h2))
    rows = back.union(dealt).repartition(chunk).sortWithinPartitions(chunk, F.col(h1).asc_nulls_last())
    return rows.mapInArrow(_chunk_apply(chunk, h1, h2, docs.columns, min_chars), schema)


def _with_counts(docs: DataFrame) -> T.StructType:
    return T.StructType([*(f for f in docs.schema if f.name not in ("n_lines", "n_dropped")), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_mb: float = 64) -> DataFrame:
    """``docs`` with ``text`` rewritten, and the columns n_lines (before) and n_dropped.

    Columns of those two names in the input are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    index, shards = build_index(docs, min_chars, min(2, min_docs))
    size = index.agg(F.sum(F.length("blob"))).first()[0] or 0
    names, schema = docs.columns, _with_counts(docs)
    if size <= broadcast_mb * 1e6:
        blobs = spark.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in index.select("shard", "blob").collect()])
        return docs.mapInArrow(_probe(names, blobs, shards, min_docs, min_chars), schema)
    return _routed(docs, index, shards, min_docs, min_chars, schema)


def query(docs: DataFrame) -> DataFrame:
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows without the perfect hash.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, pos, line, key
  FROM (SELECT rid, doc_id, pos, line,
               translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos))),
frequent AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE f.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f USING (key)
GROUP BY rid
"""
