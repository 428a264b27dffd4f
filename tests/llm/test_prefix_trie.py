import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tessera.llm import prefix_trie
from tests.llm.conftest import CLASHES

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(family, [])[:h] + turns[h:]
    return out


def brute(sequences):
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children.get(node, [])) or 1
        saved[node] = sum(saved[x] for x in children.get(node, [])) + (len(members[node]) - 1) * words
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.withColumns({c: F.lit(c) for c in (*CLASHES, "depth", "pos", "a", "b", "words", "path")})
    got = prefix_trie.query(df)
    assert got.columns == ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()]
    assert sorted(got, key=repr) == sorted(brute(rebuilt(rows)), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "a  b\n\td"])) for c in range(-25, 90) for t in range(rng.randrange(0, 6))]
    rows += [(7, None, "user", "first"), (7, None, None, None), (7, 1, "user", "a b"), (7, 1, "user", "a b"), (None, 0, "user", "lost"), (20, 3, "user", "long " * 20_000), (300, 0, "user", "alone")]
    check(spark, rows, extra=True)


def test_groups_of_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(1000, 1400) for t in range(5)] + [(2001, t, "user", f"t{t % 3}") for t in range(3000)]
    check(spark, rows)


def test_a_log_in_which_every_request_repeats_all_turns(spark):
    check(spark, [(c * 20, t, "user", f"t{t}") for c in range(60) for t in range(c + 1)])


def test_rounds_grow_with_the_logarithm_only(spark, monkeypatch):
    """A chain of 250 forks is peeled in a few rounds."""
    rows = [(c * 20, t, "user", f"t{t}" if t < c else f"own{c}") for c in range(250) for t in range(c + 1)]
    tables = []
    monkeypatch.setattr(prefix_trie, "stored", lambda df, tag, f=prefix_trie.stored: tables.append(tag) or f(df, tag))
    got = prefix_trie.query(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == len(brute(rebuilt(rows))) and tables.count("peel") <= 25


def test_ids_of_a_node_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    check(spark, [(c, 0, "user", "same") for c in range(500)])


def test_an_empty_table(spark):
    assert prefix_trie.query(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.query(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
