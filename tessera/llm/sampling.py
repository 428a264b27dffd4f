"""Bounded samples that a seed decides, without a list of candidates on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, size: int, n: int, seed: int, *keys: str) -> DataFrame:
    """The ``size`` rows that come first by a hash of ``keys``, of about ``n``; ties by the keys.

    Rows above twice the share that is wanted are passed over where they are read, so what the tasks send on doesn't
    grow with the input. (Should fewer than ``size`` lie below, as happens if n is far too large, all of these are it.)
    """
    place = F.xxhash64(*keys, F.lit(seed))
    share = 2 * size / max(1, n)
    if share < 1:
        rows = rows.where(place < int(-(2**63) + share * 2**64))
    return rows.orderBy(place, *keys).limit(size)


def shares(counts: dict, size: int) -> dict:
    """How many of each group to take for ``size`` in all: as even as their numbers allow, one at least."""
    takes, left = {}, size
    for i, (group, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        takes[group] = min(n, max(1, left // (len(counts) - i)))
        left = max(0, left - takes[group])
    return takes


def stratified_sample(rows: DataFrame, by: str, size: int, seed: int, *keys: str) -> DataFrame:
    """As ``bounded_sample``, of each value of ``by`` as many as the others, where it has so many. The driver holds a row a value."""
    place = F.xxhash64(*keys, F.lit(seed))
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    takes = [(g, t, int(min(2**63 - 1, -(2**63) + 2 * t / counts[g] * 2**64))) for g, t in shares(counts, size).items()]
    wanted = rows.sparkSession.createDataFrame(takes, f"{by} {rows.schema[by].dataType.simpleString()}, _take int, _below long")
    some = rows.join(F.broadcast(wanted), by).withColumn("_place", place).where("_place <= _below")
    first = F.row_number().over(Window.partitionBy(by).orderBy("_place", *keys))
    return some.withColumn("_first", first).where("_first <= _take").select(*rows.columns)
