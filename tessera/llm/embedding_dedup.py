"""Embedding near-dedup by an epsilon grid order join.

Vectors of unit length with a cosine of c or more are at most eps = sqrt(2 - 2 c) apart, and so are their
projections on any orthonormal directions. The directions are principal ones of a bounded sample; whatever they are,
they only decide how much can be skipped.

Equal vectors (told apart by hashes of 128 bits) become one row with a count. Rows are sorted by the cells, eps wide, of
their leading projections, and the sorted sequence is cut into strips of bounded size, each with the box around its
projections. Intervals of the sequence are joined with each other recursively: a pair of intervals whose boxes are
more than eps apart in any direction is skipped, others are divided. Down to groups of strips the recursion is a few joins of
tables of boxes; each pair of groups left is then one task, which goes on with strips and parts of
strips until it multiplies small blocks. So a strip is sent once for each group that its own can't be told apart from, and the
number of groups is about the square root of twice the number of cores, more where a group would outgrow ``GROUP_BYTES``.

The products are taken in single precision first; those too near to the threshold to tell are taken again
in double precision, component by component in order. Tasks return each vector's number of links and trees that
connect what is linked, never all pairs. What the driver holds is a row per partition of the sequence.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing, not even
its copies, and is kept; vectors of different lengths don't link; very large and very small components are scaled by powers
of two; repeated rows and ids are vectors of their own; a cosine at the threshold links; a row without an id has
the smallest id that it reaches, or null, and isn't kept unless it links with nothing; an empty table gives an empty result;
other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import batch, runs
from tessera.llm.components import Forest, connected, join_spread
from tessera.llm.sampling import bounded_sample
from tessera.session import small_batches, stored

#: Vectors that the principal directions are taken from, at most.
SAMPLE = 4096
DIRECTIONS = 8
#: Vectors of a strip and of a block that is multiplied, at most; a strip has ``STRIP_BYTES`` at most, too.
STRIP, STRIP_BYTES = 8192, 2 << 20
LEAF = 1024
#: Bytes of vectors of a group of strips, at most.
GROUP_BYTES = 32 << 20
#: Intervals that one is divided into.
_FAN = 16


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal(sample: np.ndarray, n: int = DIRECTIONS) -> np.ndarray:
    """Orthonormal columns: the directions in which unit vectors differ most."""
    unit = _unit(sample)
    _, _, rows = np.linalg.svd(unit - unit.mean(axis=0), full_matrices=False)
    return np.ascontiguousarray(rows[:n].T)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _placed(directions: np.ndarray, eps: float):
    dims, n = directions.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                near = _unit(_matrix(rows["v"], dims).astype(np.float64)) @ directions
                cells = np.floor(near / eps).astype(np.int32)
                yield batch(["node", "copies", "v", "cells"], [rows["node"], rows["copies"], rows["v"], pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), n).cast(pa.list_(pa.int32()))])

    return run


def _packed(directions: np.ndarray, wide: bool, size: int):
    dims, kind = len(directions), np.float64 if wide else np.float32

    def strip(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        v = _matrix(rows["v"].combine_chunks(), dims).astype(kind)
        near = _unit(v.astype(np.float64)) @ directions
        packed = [x.tobytes() for x in (rows["node"].to_numpy(), rows["copies"].to_numpy(), v)]
        boxes = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (near.min(axis=0), near.max(axis=0))]
        return batch(_STRIP_NAMES, [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number * size], pa.int64()), pa.array([len(v)], pa.int64()), *boxes, *(pa.array([x], pa.binary()) for x in packed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0
        for rows in batches:
            while rows.num_rows:
                held.append(rows.slice(0, size - n))
                rows, n = rows.slice(size - n), n + held[-1].num_rows
                if n == size:
                    yield strip(number, held)
                    held, n, number = [], 0, number + 1
        if held:
            yield strip(number, held)

    return run


_STRIP_NAMES = ["part", "place", "n", "lo", "hi", "nodes", "copies", "vectors"]
_STRIP = "part int, place long, n long, lo array<double>, hi array<double>, nodes binary, copies binary, vectors binary"


def _groups(strips: DataFrame, per: int) -> DataFrame:
    """Strips with ``grp``: their place in the whole order over ``per``."""
    offsets, total = [], 0
    for part, n in strips.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # a row per partition
        offsets.append((part, total))
        total += n
    table = F.broadcast(strips.sparkSession.createDataFrame(offsets, "part int, before long"))
    return strips.join(table, "part").withColumn("grp", F.floor((F.col("before") + F.col("place")) / per)).drop("part", "place", "before")


def near_pairs(boxes: DataFrame, directions: int, groups: int, eps: float) -> DataFrame:
    """(p, q), p <= q: the groups that may hold near vectors, of (grp, lo, hi). Intervals of the sequence of groups are divided
    level by level, and pairs of them whose boxes are apart go no further."""
    levels = 0
    while _FAN**levels < groups:
        levels += 1
    ks = range(directions)
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "p long, q long") if levels else boxes.select(F.col("grp").alias("p"), F.col("grp").alias("q")).distinct()
    for level in reversed(range(levels)):
        one = boxes.groupBy(F.floor(F.col("grp") / _FAN**level).alias("id")).agg(
            F.array(*(F.min(F.get("lo", F.lit(k))) for k in ks)).alias("lo"), F.array(*(F.max(F.get("hi", F.lit(k))) for k in ks)).alias("hi"))
        side = lambda s, up: one.select(F.floor(F.col("id") / _FAN).alias(up), *(F.col(c).alias(c + s) for c in ("id", "lo", "hi")))  # noqa: B023, E731
        near = F.lit(True)
        for k in ks:
            lo_a, hi_a, lo_b, hi_b = (F.get(c, F.lit(k)) for c in ("lo_a", "hi_a", "lo_b", "hi_b"))
            near = near & (lo_a - hi_b <= eps) & (lo_b - hi_a <= eps)
        pairs = pairs.join(side("_a", "p"), "p").join(side("_b", "q"), "q").where((F.col("id_a") <= F.col("id_b")) & near).select(F.col("id_a").alias("p"), F.col("id_b").alias("q"))
    return pairs


def _apart(lo_a, hi_a, lo_b, hi_b, eps: float) -> bool:
    return bool((np.maximum(lo_a - hi_b, lo_b - hi_a) > eps).any())


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled by powers of two first, which changes no digit."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a.astype(np.float64), b.astype(np.float64)))
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        x += a[:, k] * a[:, k]
        y += b[:, k] * b[:, k]
    return dot / np.sqrt(x) / np.sqrt(y)


class Strip:
    """Vectors that follow each other in the order, with what the join needs of them."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray, directions: np.ndarray, nodes: np.ndarray | None = None):
        unit = _unit(vectors.astype(np.float64))
        self.vectors, self.copies, self.nodes = vectors, copies, nodes
        self.near, self.single = unit @ directions, unit.astype(np.float32)
        self.lo, self.hi = self.near.min(axis=0), self.near.max(axis=0)
        self.links = np.zeros(len(vectors))

    def __len__(self) -> int:
        return len(self.vectors)


def join_strips(a: Strip, b: Strip, eps: float, least: float, leaf: int = LEAF) -> Forest:
    """Adds to the links of both, copies counted, and returns the trees (rows of b come after those of a, unless b is a)."""
    own, shift = a is b, 0 if a is b else len(a)
    margin = np.float32(4e-7 * (a.vectors.shape[1] + 8))
    forest = Forest(shift + len(b))
    todo = [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        if _apart(a.near[p:q].min(axis=0), a.near[p:q].max(axis=0), b.near[r:s].min(axis=0), b.near[r:s].max(axis=0), eps):
            continue
        same = own and (p, q) == (r, s)
        if max(q - p, s - r) > leaf:
            m, n = (p + q) // 2, (r + s) // 2
            todo += [(p, m, p, m), (p, m, m, q), (m, q, m, q)] if same else [(p, m, r, s), (m, q, r, s)] if q - p >= s - r else [(p, q, r, n), (p, q, n, s)]
            continue
        product = a.single[p:q] @ b.single[r:s].T
        i, j = np.divmod(np.flatnonzero(product.ravel() >= least - margin), s - r)
        if same:
            upper = i < j
            i, j = i[upper], j[upper]
        value = product[i, j]
        doubtful = np.flatnonzero(value < least + margin)
        fits = np.ones(len(i), bool)
        for at in range(0, len(doubtful), 1 << 16):
            part = doubtful[at : at + (1 << 16)]
            fits[part] = cosines(a.vectors[p + i[part]], b.vectors[r + j[part]]) >= least
        i, j = p + i[fits], r + j[fits]
        if len(i):
            a.links += np.bincount(i, b.copies[j], len(a))
            b.links += np.bincount(j, a.copies[i], len(b))
            forest.join(i, j + shift)
    return forest


def _joined(directions: np.ndarray, eps: float, least: float, wide: bool, leaf: int):
    dims, kind = len(directions), np.float64 if wide else np.float32

    def counted(strips: list[Strip]) -> pa.RecordBatch:
        x, y = np.concatenate([s.nodes for s in strips]), np.concatenate([s.links for s in strips])
        some = np.flatnonzero(y)
        return batch(["edge", "a", "b"], [np.zeros(len(some), bool), x[some], y[some].astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in runs(batches, "cell"):  # the strips of one group, then those of the other
            held: list[Strip] = []
            for rows in parts:
                for r in rows.to_pylist():
                    nodes, copies, vectors = (np.frombuffer(r[c], t) for c, t in (("nodes", np.int64), ("copies", np.int64), ("vectors", kind)))
                    strip = Strip(vectors.reshape(-1, dims), copies, directions, nodes)
                    if not r["second"]:
                        held.append(strip)
                    for other in held if r["second"] or r["alone"] else ():
                        if _apart(other.lo, other.hi, strip.lo, strip.hi, eps):
                            continue
                        child, root = join_strips(other, strip, eps, least, leaf).links()
                        names = strip.nodes if other is strip else np.concatenate([other.nodes, strip.nodes])
                        yield batch(["edge", "a", "b"], [np.ones(len(child), bool), names[child], names[root]])
                    if r["second"]:
                        yield counted([strip])
            if held:
                yield counted(held)

    return run


def _links(nodes: DataFrame, dims: int, least: float, wide: bool) -> DataFrame:
    """(edge, a, b): edges between nodes, or a node and a number of linked vectors."""
    spark = nodes.sparkSession
    small_batches(spark)
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + 1e-9) + 1e-9
    n, cores, width = nodes.count(), spark.sparkContext.defaultParallelism, dims * (8 if wide else 4)
    sample = bounded_sample(nodes, SAMPLE, n, 8, "node").select("v").toArrow()["v"].combine_chunks()
    directions = principal(_matrix(sample, dims).astype(np.float64))
    kind = f"array<{'double' if wide else 'float'}>"
    cells = nodes.mapInArrow(_placed(directions, eps), f"node long, copies long, v {kind}, cells array<int>")
    size = max(1, min(STRIP, STRIP_BYTES // width))
    parts = max(1, min(-(-n // size), 4 * cores), -(-n // (64 * size)))
    ordered = cells.repartitionByRange(parts, "cells", "node").sortWithinPartitions("cells", "node").drop("cells")
    strips = stored(ordered.mapInArrow(_packed(directions, wide, size), _STRIP), "strips")
    side = max(1, int(np.ceil(np.sqrt(2 * cores))))
    per = max(1, min(max(-(-n // side), LEAF), max(size, GROUP_BYTES // width)))
    strips = _groups(strips, per)
    groups = -(-n // per)
    pairs = stored(near_pairs(strips.select("grp", "lo", "hi"), directions.shape[1], groups, eps), "strip-pairs")
    one = strips.drop("n", "lo", "hi").withColumnRenamed("grp", "p").join(pairs, "p").withColumn("second", F.lit(False))
    two = strips.drop("n", "lo", "hi").withColumnRenamed("grp", "q").join(pairs.where("p < q"), "q").withColumn("second", F.lit(True))
    work = one.unionByName(two).select((F.col("p") * groups + F.col("q")).alias("cell"), (F.col("p") == F.col("q")).alias("alone"), "second", "nodes", "copies", "vectors")
    n_pairs = max(1, pairs.count())
    work = work.repartition(min(4 * n_pairs, max(n_pairs, 4096)), "cell").sortWithinPartitions("cell", "second")
    return stored(work.mapInArrow(_joined(directions, eps, least, wide, LEAF), "edge boolean, a long, b long"), "links")


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding)."""
    wide = vectors.schema["embedding"].dataType.elementType.simpleString() != "float"
    fits = usable(F.col("embedding"))
    rows = vectors.where(fits).select("vec_id", F.col("embedding").cast(f"array<{'double' if wide else 'float'}>").alias("v"))
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    nodes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = None
    for (dims,) in sorted(nodes.select(F.size("v")).distinct().collect()):
        part = _links(nodes.where(F.size("v") == dims).select("node", "copies", "v"), dims, least, wide)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "edge boolean, a long, b long")
    names = nodes.drop("v")
    counts = found.where(~F.col("edge")).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    roots = connected(found.where("edge").select("a", "b"))
    linked = stored(roots.join(names.select("node", "first"), "node"), "linked-vectors")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"), F.count("*").alias("n"))
    linked = join_spread(linked, lowest, ["root"], "n", linked.count()).select("node", "lowest")
    named = names.join(counts, "node", "left").join(linked, "node", "left")
    named = stored(named.select("h1", "h2", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "first").alias("component_id")), "named-vectors")
    out = join_spread(rows.select("vec_id", "h1", "h2"), named, ["h1", "h2"], "copies", named.agg(F.sum("copies")).first()[0] or 0)
    alone = vectors.where(~fits).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), (F.col("n_links") == 0) & F.col("vec_id").isNull()))


def query(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors.select("vec_id", "embedding"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y
  WHERE x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON r.other = l.a),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT l.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, l.vec_id = component_id AS kept
FROM lowest l LEFT JOIN counts c ON c.a = l.vec_id
"""
