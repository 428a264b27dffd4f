"""Connected components of a distributed edge table.

Alternating large-star and small-star rounds: every round is two grouped minima (summed before the
shuffle) and two joins, and the number of rounds grows with the logarithm of the longest chain. Each
half round is a table in the shared folder; nothing is gathered on the driver but two numbers a round. A hub's edges are joined
where they lie, so the largest component is no task of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


#: A key with more rows than this share of all, and than so many, is joined by broadcast.
_COMMON, _COMMON_ROWS = 1000, 1000


def join_spread(rows: DataFrame, one: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which has a row a key and in ``copies`` how many of the ``total`` rows have that key, or less.

    The rows of a key with over a thousandth of all aren't shuffled: there are fewer than a thousand such keys, whose rows of
    ``one`` are broadcast.
    """
    bound = max(_COMMON_ROWS, total // _COMMON)
    common = one.where(F.col(copies) > bound)
    rest = rows.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(one.where(F.col(copies) <= bound), keys)
    return rows.join(F.broadcast(common), keys).unionByName(rest)


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids, any order, repeats and loops allowed -> (node, root).

    ``root`` is the smallest node reachable. Nodes without a link to another node are absent; null
    ends are ignored; an empty table gives an empty result.
    """
    links = edges.where(F.col("a") != F.col("b"))
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        large = join_spread(both, lowest, ["u"], "n", 2 * before[0]).where("v > u")
        large = stored(large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_spread(large, lowest, ["u"], "n", 2 * before[0])
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        links = stored(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct(), "edges")
        now = _state(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


class Forest:
    """Components of the rows of one task, kept as an array and joined pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def _flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            self._flatten()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row that isn't its tree's root: the row and the root."""
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]
