"""Digests of whole tables that tasks take together.

A table's rows, in a total order, are the leaves of a tree of hashes: ``FAN`` neighbours make a node, ``LEVELS`` times over, and
what is left is hashed on the driver, one row in ``FAN`` ** ``LEVELS``. Nodes are cut by place, so the digest is of rows and order
alone, however they are partitioned. No group is larger than ``FAN``.

A digest that is defined as one hash over a sorted list (``of_sorted``) can't be a tree; there the list is sorted and written out in
parallel, and one task hashes long pieces of it as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.digests import framed

FAN, LEVELS = 256, 3
#: Values in one piece of a sorted list.
PIECE = 1 << 15


def nodes(rows: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(at, d, n): the nodes of the last level, of leaves (at, d), places from 0 and digests in hex. n: the leaves below."""
    level = rows.withColumn("n", F.lit(1).cast("long"))
    for _ in range(levels):
        own = F.transform(F.sort_array(F.collect_list(F.struct("at", "d"))), lambda x: x["d"])
        level = level.groupBy(F.floor(F.col("at") / fan).alias("above")).agg(F.sha2(F.unhex(F.array_join(own, "")), 256).alias("d"), F.sum("n").alias("n"))
        level = level.select(F.col("above").alias("at"), "d", "n")
    return level


def tree_digest(rows: DataFrame, at: Column, leaf: Column, tag: str, fan: int = FAN, levels: int = LEVELS) -> str:
    """The digest of ``rows`` in the order of ``at``, which has each place from 0 once; ``leaf`` is a row's own digest, in hex."""
    top = nodes(rows.select(at.cast("long").alias("at"), leaf.alias("d")), fan, levels).orderBy("at").collect()
    return framed([tag, sum(r["n"] for r in top).to_bytes(8, "big"), *(r["d"] for r in top)])


def _pieces(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            values = b[column].to_pylist()
            for i in range(0, len(values), PIECE):
                text = "".join(f"{len(v.encode())}:{v}" for v in values[i : i + PIECE])
                yield pa.RecordBatch.from_arrays([b["range"].slice(i, 1), pa.array([n]), pa.array([text])], names=["range", "piece", "text"])
                n += 1

    return run


def of_sorted(rows: DataFrame, column: str, head: str) -> str:
    """SHA-256 of ``head`` and then each value of a string column after its length in bytes, values sorted bytewise."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(column).repartitionByRange(parts, column).sortWithinPartitions(column).withColumn("range", F.spark_partition_id())
    pieces = dealt.mapInArrow(_pieces(column), "range int, piece long, text string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256(head.encode())
        for b in batches:
            for text in b["text"].to_pylist():
                digest.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=["digest"])

    found = pieces.repartition(1).sortWithinPartitions("range", "piece").mapInArrow(hashed, "digest string").collect()
    return found[0]["digest"] if found else hashlib.sha256(head.encode()).hexdigest()


@F.arrow_udf(T.StringType())
def floats_digest(values: pa.Array) -> pa.Array:
    """SHA-256 of a list of floats, in single precision, the high byte first; null for a null."""
    raw, ends = values.values.to_numpy(zero_copy_only=False).astype(">f4").tobytes(), (4 * values.offsets.to_numpy()).tolist()
    known = np.asarray(values.is_valid())
    return pa.array([hashlib.sha256(raw[a:b]).hexdigest() if ok else None for a, b, ok in zip(ends, ends[1:], known)])
