"""A trie of conversations by shared first turns, its subtrees added up by peeling leaves.

A turn is known by a digest of its role and text, a node by its depth and an exclusive or of hashes of (depth, digest) of its turns,
128 bits in all. So the prefixes of a conversation are running totals, and a conversation of any length can lie in many tasks.

Subtrees are added up by messages. A node holds how many of its children haven't reported; one that waits for none sends its
totals to its parent, until only the root is left. Whole paths go at once: of the conversations through a node the one that comes
first by a hash of its id stands for it, so the nodes that one conversation stands for are a path downward, and a path is complete as
soon as all paths that hang on it are. Along a path, totals are running sums. The first by a hash changes only with the logarithm
of the number of conversations on the way from the root to a leaf (in expectation, whatever the trie), and so do the rounds; a chain
of nodes with one child each, or a log in which every request repeats all turns before, costs no round a turn. Each round is a table in the
shared folder; the driver sees one number.

Nodes with over a thousandth of all children are joined with them by broadcast (``join_spread``). The ids that end at a node are
joined in pieces where they were sorted, and a node's hash is taken over its pieces as a stream.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null role or text is empty; turns that tie are
ordered by role and the first 64 characters, then by digest; repeated rows are turns like others; very long texts are digested whole
where they are read and not shuffled; an empty table has no root, so the result is empty; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import batch
from tessera.llm.components import join_spread
from tessera.llm.scans import running
from tessera.session import small_batches, stored

#: Conversations of this many ids in a row share turns of the first of them, fewer than so many each.
FAMILY, SHARED = 20, 4
_WORD = r"[^\x20\x09-\x0D]+"
_TIE = 64
#: Ids in one piece of a node's list.
PIECE = 1 << 16
_NODE = ["depth", "a", "b"]


# --- sequences of turns -----------------------------------------------------------------------


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, said, words): turns by number, null first."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    spoken = F.concat(role, F.lit("\0"), text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(spoken, 1, _TIE).alias("tie"), F.md5(spoken.cast("binary")).alias("said"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("pos"))
    return running(stored(rows, "turns"), "conv_id", [F.asc_nulls_first("turn"), "tie", "said"], {"pos": "sum"}, "ordered").select("conv_id", "pos", "said", "words")


def shared(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its family's first."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, said, words) and (conv_id): conversations whose first turns are those of their family's first."""
    own = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": shared(F.col("conv_id")), "family": F.col("conv_id") - F.col("conv_id") % FAMILY}), "conversations")
    firsts = own.where("conv_id = family").select("family", F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0).cast("long")))
    convs = stored(own.join(firsts, "family", "left").withColumn("taken", taken), "families")
    total = convs.agg(F.sum("n")).first()[0] or 0
    rest = join_spread(turns.where(F.col("pos") > shared(F.col("conv_id"))), convs.select("conv_id", "n", "h", "taken"), ["conv_id"], "n", total)
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "said", "words")
    # fewer than SHARED turns of a family's first, and no more than FAMILY conversations on either side of zero
    heads = turns.where((F.col("pos") < SHARED) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "family")
    heads = heads.join(convs.select("conv_id", "family", "h"), "family").where("pos <= h")
    return rest.unionByName(heads.select("conv_id", F.col("pos").alias("depth"), "said", "words")), convs.select("conv_id")


# --- the trie ------------------------------------------------------------------------------------


def paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row per conversation and prefix, the root's included: (conv_id, depth, a, b, up_a, up_b, words)."""
    one, two = F.xxhash64("depth", "said"), F.xxhash64("said", "depth", F.lit("second"))
    own = stored(turns.select("conv_id", "depth", "words", one.alias("a"), two.alias("b"), one.alias("own_a"), two.alias("own_b")), "sequences")
    found = running(own, "conv_id", ["depth"], {"a": "xor", "b": "xor"}, "prefixes")
    found = found.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"), "words")
    zero = F.lit(0).cast("long")
    root = conversations.select("conv_id", *(zero.alias(c) for c in _NODE), *(F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")), zero.alias("words"))
    return found.unionByName(root)


def nodes(found: DataFrame) -> DataFrame:
    """A row per node: its key, conv_id, n_convs, n_children, its path, its parent's conv_id and path, and its own leaves and saved."""
    first = F.min(F.struct(F.xxhash64("conv_id").alias("order"), "conv_id")).alias("first")
    own = stored(found.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), first, F.count("*").alias("n_convs"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.min("words").alias("words")), "nodes")
    fan = own.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    own = own.join(fan, _NODE, "left").select(
        *_NODE, "conv_id", F.col("first.conv_id").alias("path"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (F.col("depth") - 1).alias("up_depth"), "up_a", "up_b",
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = stored(own.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "fans")
    above = own.where("n_children > 0").select(F.col("depth").alias("up_depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up_path"), F.col("n_children").alias("fan"))
    below = join_spread(own.where("depth > 0"), above, ["up_depth", "up_a", "up_b"], "fan", own.count()).drop("fan", "up_depth", "up_a", "up_b")
    root = own.where("depth = 0").drop("up_depth", "up_a", "up_b").withColumns({"parent_conv_id": F.lit(None).cast("long"), "up_path": F.lit(None).cast("long")})
    return stored(below.unionByName(root), "linked")


def peeled(linked: DataFrame) -> DataFrame:
    """(path, up_path, up_depth, leaves, saved): each path's totals with all that hangs on it, and the node it hangs on."""
    top = F.col("up_path").isNull() | (F.col("up_path") != F.col("path"))
    state = linked.groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(top, F.col("up_path"))).alias("up_path"), F.max(F.when(top, F.col("depth") - 1)).alias("up_depth"))
    hanging = linked.where(top & F.col("up_path").isNotNull()).groupBy(F.col("up_path").alias("path")).agg(F.count("*").alias("waits"))
    state = stored(state.join(hanging, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0)).cast("long")), "peel")
    done = []
    while True:
        ready = state.where("waits = 0")
        done.append(ready.drop("waits"))
        sent = ready.where("up_path IS NOT NULL").groupBy(F.col("up_path").alias("path")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("reports"))
        got = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        left = state.where("waits > 0").join(sent, "path", "left").withColumns({
            "leaves": F.col("leaves") + got("more_leaves"), "saved": F.col("saved") + got("more_saved"), "waits": F.col("waits") - got("reports")})
        state = stored(left.drop("more_leaves", "more_saved", "reports"), "peel")
        if not state.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def subtrees(linked: DataFrame) -> DataFrame:
    """``linked`` with leaves and saved of whole subtrees."""
    hung = peeled(linked).where("up_path IS NOT NULL").groupBy(F.col("up_path").alias("path"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    both = linked.join(hung, ["path", "depth"], "left")
    both = both.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)).cast("long") for c in ("leaves", "saved")}).drop("more_leaves", "more_saved")
    return running(stored(both, "own"), "path", [F.desc("depth")], {"leaves": "sum", "saved": "sum"}, "subtrees")


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each node of a sorted batch with its rows."""
    keys = np.stack([b[c].to_numpy() for c in _NODE])
    starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows] if b.num_rows else []
    for s, e in zip(starts, starts[1:]):
        yield tuple(keys[:, s].tolist()), b.slice(s, e - s)


_PIECES = "depth long, a long, b long, first long, ids string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids -> (node, first id, ids joined), in pieces of a batch or ``PIECE`` at most."""
    for b in batches:
        out = [(*node, *(ids := part["conv_id"].slice(at, PIECE).to_pylist())[:1], ",".join(map(str, ids))) for node, part in _runs(b) for at in range(0, part.num_rows, PIECE)]
        yield batch([x.split()[0] for x in _PIECES.split(", ")], [list(c) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4 + [pa.array([], pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces by node and first id -> (node, SHA-256 of all its ids, joined)."""
    node, digest = None, None
    for b in batches:
        out = []
        for key, part in _runs(b):
            if key != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest, mark = key, hashlib.sha256(), b""
            for ids in part["ids"].to_pylist():
                digest.update(mark + ids.encode())
                mark = b","
        if out:
            yield batch([*_NODE, "sha256"], [list(c) for c in zip(*out)])
    if node is not None:
        yield batch([*_NODE, "sha256"], [[x] for x in (*node, digest.hexdigest())])


def ends(found: DataFrame) -> DataFrame:
    """(depth, a, b, sha256) of the nodes where conversations end."""
    last = stored(found.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("end")).select("conv_id", "end.*"), "ends")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = last.repartitionByRange(parts, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = dealt.mapInArrow(_pieces, _PIECES).repartition(*_NODE).sortWithinPartitions(*_NODE, "first")
    return pieces.mapInArrow(_hashed, "depth long, a long, b long, sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of sequences (conv_id, depth from 1, said, words) of ``conversations`` (conv_id), of which some may be turnless.

    (depth, a, b): the node; conv_id: its smallest member; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens; ends_sha256.
    """
    small_batches(turns.sparkSession)
    found = stored(paths(turns, conversations), "paths")
    own = subtrees(nodes(found)).join(ends(found), _NODE, "left")
    return own.select(
        *_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def query(conversations: DataFrame) -> DataFrame:
    """The contract's columns, of conversations rebuilt by family."""
    return trie(*rebuilt(ordered(conversations.select("conv_id", "turn", "role", "text")))).drop("a", "b")


#: From lists of whole prefixes. crc32 of short ASCII texts, bit by bit.
ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, left(coalesce(role, '') || chr(0) || coalesce(text, ''), {_TIE}), md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT conv_id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS crc FROM t),
c AS (SELECT conv_id, (xor(crc, 4294967295::UBIGINT) % {SHARED})::BIGINT AS h, conv_id - conv_id % {FAMILY} AS family FROM k),
u AS (SELECT c.conv_id, pos, 0 AS own, role, text FROM c JOIN t ON t.conv_id = family AND pos <= h UNION ALL SELECT c.conv_id, pos, 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, {{'role': role, 'text': text}} AS said, len(regexp_extract_all(text, '{_WORD}')) AS words FROM u),
s AS (SELECT conv_id, list(said ORDER BY depth) AS whole, list(words ORDER BY depth) AS words FROM r GROUP BY conv_id),
f AS (SELECT c.conv_id, coalesce(whole, []) AS whole, coalesce(words, []) AS words FROM c LEFT JOIN s USING (conv_id)),
p AS (SELECT conv_id, unnest(range(len(whole) + 1)) AS depth, whole, words FROM f),
n AS (SELECT depth, list_slice(whole, 1, depth) AS node, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(whole) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends,
    any_value(CASE WHEN depth > 0 THEN words[depth] ELSE 0 END) AS words FROM p GROUP BY 1, 2),
x AS (SELECT n.*, up.conv_id AS parent_conv_id FROM n LEFT JOIN n up ON up.depth = n.depth - 1 AND up.node = list_slice(n.node, 1, n.depth - 1)),
y AS (SELECT x.*, (SELECT count(*) FROM n z WHERE z.depth = x.depth + 1 AND list_slice(z.node, 1, z.depth - 1) = x.node) AS n_children FROM x),
v AS (SELECT unnest(range(depth + 1)) AS d, node, n_children, n_convs, words FROM y),
sums AS (SELECT d AS depth, list_slice(node, 1, d) AS node, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM v GROUP BY 1, 2)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM y JOIN sums USING (depth, node)
"""
