"""Places of rows in a total order, without a task that sees them all.

Rows are dealt by ranges of the order and sorted where they land. A row's place is the number of rows in the ranges before, of
which the driver sees one number a range, and its place within its own.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import stored

#: Bits of ``monotonically_increasing_id`` that count a partition's rows; the others are the partition.
_ROW_BITS = 33


def ranged(rows: DataFrame, *order: str | Column, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and sorted, with the range and the place in it as one number. Ties in ``order`` share a range."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def offsets(placed: DataFrame, name: str) -> list[tuple[int, int]]:
    """(range, rows in the ranges before it) of a stored table of ``ranged`` rows."""
    counts = placed.groupBy(F.shiftright(name, _ROW_BITS).alias("range")).agg(F.count("*").alias("n")).collect()
    counts = sorted((r["range"], r["n"]) for r in counts)
    return list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))


def placed_in(placed: DataFrame, before: list[tuple[int, int]], name: str) -> DataFrame:
    """A stored table of ``ranged`` rows, with their places in the whole order, from 0, in ``name``."""
    found = placed.sparkSession.createDataFrame(before, "_range long, _before long")
    place = F.col(name).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_before")
    both = placed.join(F.broadcast(found), F.shiftright(name, _ROW_BITS) == F.col("_range"))
    return both.select(*(place.alias(c) if c == name else c for c in placed.columns))


def numbered(rows: DataFrame, *order: str | Column, name: str, parts: int | None = None) -> DataFrame:
    """``rows`` with their places in ``order``, from 0. Rows that tie throughout get different places, in no certain order."""
    placed = stored(ranged(rows, *order, name=name, parts=parts), "ranges")
    return placed_in(placed, offsets(placed, name), name)
