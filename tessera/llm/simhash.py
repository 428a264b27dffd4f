"""SimHash near-dedup with pigeonring filtering.

A document's fingerprint has one bit per bit of its shingles' hashes: 1 if set in over half of them.
Two fingerprints link when at most ``max_bits`` of their bits differ.

Candidates come from a ring of m segments, m > max_bits. If two fingerprints differ in at most t bits,
then from some segment on, the differences of the next 1, 2, .. m segments sum to at most
floor(1 t/m), floor(2 t/m), .. t. The first of these budgets is 0, so that segment is equal: each
distinct fingerprint is dealt once per segment, by the segment's value. Within a task the chain goes
on: the next ``c`` segments are looked up in sorted order with every bit pattern their budgets allow, and
only fingerprints found so reach the full comparison. c follows from the number of fingerprints and
changes the cost, not the result.

Exact copies share a fingerprint and are one node. A value of one segment that more than ``block``
fingerprints share is dealt in blocks, each pair of blocks a group of its own, so that no task holds an
unbounded group. Tasks send on the trees of what they linked, never all pairs; components are then found
over the whole table.

For pairs further apart than the ring on 64 bits can tell from chance, a fingerprint can have more words
(``sketch_words``): the ring runs on the first, and a pair links if all words together differ in at most
``max_sketch_bits``.

Defined cases: a null, empty or blank text has the fingerprint zero and links like any other; fewer words
than a shingle takes count as one shingle; ties in a bit's vote give 0; very long texts are hashed whole; repeated rows and ids
are rows of their own, so of equal rows ``near_dedup`` keeps one, and a text of its own stays whatever else has its id;
rows without an id get the smallest id they reach, or null, and are kept only where no row of their group has one; an empty
table gives an empty result; other columns pass through ``near_dedup`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import ASCII_LOWER, as_bytes, batch, fresh
from tessera.llm.components import Forest, connected, join_spread
from tessera.session import small_batches, stored

SEED = 42
#: Fingerprints a task compares as one group at most.
BLOCK = 200_000
#: Candidate pairs compared at a time.
_CHUNK = 1 << 20
_STEP = 1 << 16


# --- fingerprints -------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return np.fromiter([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64, len(starts))


def _remix(h: np.ndarray, word: int) -> np.ndarray:
    """Further hash words of the same shingles."""
    if not word:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, word: int = 0) -> int:
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = _remix(hashes[at : at + _STEP], word).astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">u8")[0])


def _fingerprints(size: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hashed = [shingle_hashes(t, size) for t in as_bytes(rows["text"])]
            columns = [np.array([fingerprint(h, k) for h in hashed], np.uint64).view(np.int64) for k in range(words)]
            yield batch(["doc_id", "row", *(f"f{k}" for k in range(words))], [rows["doc_id"], rows["row"], *columns])

    return run


def fingerprints(docs: DataFrame, shingle: int, words: int = 1, row: Column | None = None) -> DataFrame:
    """(doc_id, row, f0, f1, ..): the words of each document's fingerprint. row: what tells rows of one id apart, else 0."""
    small_batches(docs.sparkSession)
    row = F.lit(0).cast("long") if row is None else row
    return docs.select("doc_id", "text", row.alias("row")).mapInArrow(_fingerprints(shingle, words), "doc_id long, row long, " + ", ".join(f"f{k} long" for k in range(words)))


# --- the ring -----------------------------------------------------------------------------


class Ring:
    """m = t + 1 segments of a 64-bit word, and the budgets of chains of them."""

    def __init__(self, max_bits: int):
        self.tau, self.m = max_bits, max_bits + 1
        self.widths = [64 * (i + 1) // self.m - 64 * i // self.m for i in range(self.m)]
        self.starts = [64 * i // self.m for i in range(self.m)]

    def budget(self, length: int) -> int:
        return length * self.tau // self.m

    def width(self, start: int, segment: int) -> int:
        return self.widths[(start + segment) % self.m]

    def masks(self, start: int, more: int) -> list[int]:
        """The differences that the chain allows in the ``more`` segments after the first."""
        found = [(0, 0)]
        for k in range(1, more + 1):
            w = self.width(start, k)
            flips = sorted(range(1 << w), key=lambda x: (x.bit_count(), x))
            found = [(mask << w | x, used + x.bit_count()) for (mask, used), x in product(found, flips) if used + x.bit_count() <= self.budget(k + 1)]
        return [mask for mask, _ in found]

    def more(self, n: int) -> int:
        """How many segments to look up, by the expected cost over n fingerprints."""

        def cost(c: int) -> float:
            bits = sum(self.width(0, k) for k in range(c + 1))
            return len(self.masks(0, c)) * (15 + n / 2**bits)

        return min((c for c in range(min(3, self.m - 1) + 1) if sum(self.width(0, k) for k in range(1, c + 1)) <= 16), key=cost)

    def key(self, column: Column, start: int) -> Column:
        """The value of a segment, counted on over the segments before it."""
        at, w = self.starts[start], self.widths[start]
        turned = F.shiftleft(column, at).bitwiseOR(F.shiftrightunsigned(column, 64 - at)) if at else column
        base = sum(1 << x for x in self.widths[:start])
        return (F.shiftrightunsigned(turned, 64 - w) + F.lit(base)).cast("int")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _pairs(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for lo[i] <= j < hi[i], in chunks of bounded size."""
    n = np.maximum(hi - lo, 0)
    rows = np.flatnonzero(n)
    while len(rows):
        total = np.cumsum(n[rows])
        take = max(1, int(np.searchsorted(total, _CHUNK, "right")))
        part, count = rows[:take], n[rows[:take]]
        if take == 1 and count[0] > _CHUNK:
            i = int(part[0])
            for at in range(int(lo[i]), int(hi[i]), _CHUNK):
                j = np.arange(at, min(at + _CHUNK, int(hi[i])))
                yield np.full(len(j), i), j
        else:
            first = np.repeat(np.cumsum(count) - count, count)
            yield np.repeat(part, count), np.repeat(lo[part], count) + np.arange(int(count.sum())) - first
        rows = rows[take:]


def link_rows(ring: Ring, more: int, start: np.ndarray, group: np.ndarray, side: np.ndarray, cross: np.ndarray, words: np.ndarray, node: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Trees over the linked fingerprints of one task. group: rows with one number share a segment's value
    (and a pair of blocks); cross: only rows of different sides are compared there."""
    names, at = np.unique(node, return_inverse=True)
    forest = Forest(len(names))
    for s in np.unique(start):
        mine = np.flatnonzero(start == s)
        bits = sum(ring.width(int(s), k) for k in range(1, more + 1))
        turned = _turned(words[0][mine], ring.starts[s]) << np.uint64(ring.widths[s])
        sub = (turned >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(mine), np.int64)
        full = np.unique(group[mine], return_inverse=True)[1].astype(np.int64) << bits | sub
        order = np.argsort(full, kind="stable")
        mine, full = mine[order], full[order]
        w, across, sides, nodes = [x[mine] for x in words], cross[mine], side[mine], at[mine]
        for mask in ring.masks(int(s), more):
            wanted = full ^ mask
            lo = np.maximum(np.searchsorted(full, wanted, "left"), np.arange(1, len(full) + 1))
            for i, j in _pairs(lo, np.searchsorted(full, wanted, "right")):
                near = np.bitwise_count(w[0][i] ^ w[0][j]) <= ring.tau
                i, j = i[near], j[near]
                fits = ~across[i] | (sides[i] != sides[j])
                if len(w) > 1:
                    fits &= sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in w) <= limit
                forest.join(nodes[i[fits]], nodes[j[fits]])
    child, root = forest.links()
    return names[child], names[root]


def _linked(ring: Ring, more: int, words: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        get = lambda c: rows[c].to_numpy()
        key = np.rec.fromarrays([get("bucket"), get("p"), get("q")])
        group = np.unique(key, return_inverse=True)[1]
        a, b = link_rows(ring, more, get("start"), group, get("side"), get("p") != get("q"), [get(f"f{k}").view(np.uint64) for k in range(words)], get("node"), limit)
        yield batch(["a", "b"], [pa.array(a, pa.int64()), pa.array(b, pa.int64())])

    return run


def links(nodes: DataFrame, max_bits: int, words: int = 1, max_sketch_bits: int = 0, block: int = BLOCK) -> DataFrame:
    """(a, b) trees that connect what the fingerprints (node, f0, f1, ..) link."""
    ring, spark = Ring(max_bits), nodes.sparkSession
    n = nodes.count()
    names = ["node", *(f"f{k}" for k in range(words))]
    dealt = F.explode(F.array(*(F.struct(F.lit(s).alias("start"), ring.key(F.col("f0"), s).alias("bucket")) for s in range(ring.m)))).alias("x")
    rows = nodes.select(*names, dealt).select(*names, "x.start", "x.bucket")
    # at most one row per value of a segment, whatever the input
    large = rows.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(large), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*names, "start", "bucket", "side", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * ring.m // 1_000_000))
    return rows.repartition(parts, "bucket", "p", "q").mapInArrow(_linked(ring, ring.more(n), words, max_sketch_bits), "a long, b long")


def _grouped(prints: DataFrame, own: list[str], max_bits: int, max_sketch_bits: int, block: int) -> DataFrame:
    """``prints`` with ``lowest``: of the rows in reach the first one by id (those without come last) and row."""
    found = stored(prints.withColumn("node", F.col("f0") if len(own) == 1 else F.xxhash64(*own)), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = stored(found.groupBy("node", *own).agg(F.min(first).alias("first"), F.count("*").alias("copies")), "fingerprint-nodes")
    roots = connected(links(nodes, max_bits, len(own), max_sketch_bits, block))
    linked = stored(roots.join(nodes.select("node", "first"), "node"), "linked-nodes")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"), F.count("*").alias("n"))
    linked = join_spread(linked, lowest, ["root"], "n", linked.count()).select("node", "lowest")
    named = stored(nodes.join(linked, "node", "left").select("node", "copies", F.coalesce("lowest", "first").alias("lowest")), "named-nodes")
    return join_spread(found, named, ["node"], "copies", named.agg(F.sum("copies")).first()[0] or 0)


def near_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, sketch_words: int = 1, max_sketch_bits: int = 0, block: int = BLOCK) -> DataFrame:
    """(doc_id, f0, .., component_id): the smallest id that a document reaches by links, itself included."""
    own = [f"f{k}" for k in range(sketch_words)]
    groups = _grouped(fingerprints(docs, shingle, sketch_words), own, max_bits, max_sketch_bits, block)
    return groups.select("doc_id", *own, F.col("lowest.doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4, sketch_words: int = 1, max_sketch_bits: int = 0, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group: that of its smallest id, the first if several have it."""
    (row,) = fresh(docs.columns, "row")
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    own = [f"f{k}" for k in range(sketch_words)]
    groups = _grouped(fingerprints(held, shingle, sketch_words, F.col(row)), own, max_bits, max_sketch_bits, block)
    gone = groups.where(F.col("row") != F.col("lowest.row")).select(F.col("row").alias(row))
    return held.join(gone, row, "left_anti").select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    groups = near_groups(docs, shingle=4, max_bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
