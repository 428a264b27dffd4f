"""Running totals within groups of any size.

Rows are dealt by ranges of (group, order), so a large group lies in many tasks. Each task totals what it has; the
driver sees the two ends of each range, a row a range, and what a group's earlier ranges came to is added to the rest of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import fresh
from tessera.session import stored

_ADD = {"sum": lambda a, b: (a + b + 2**63) % 2**64 - 2**63, "xor": lambda a, b: a ^ b}


def _totals(values: np.ndarray, starts: np.ndarray, run: np.ndarray, how: str) -> np.ndarray:
    """Totals from each run's start on."""
    if how == "sum":
        total = np.cumsum(values)
        return total - (total[starts] - values[starts])[run]
    total = np.bitwise_xor.accumulate(values)
    return total ^ (total[starts] ^ values[starts])[run]


def running(rows: DataFrame, group: str, order: list[str | Column], values: dict[str, str], tag: str = "running") -> DataFrame:
    """A stored table of ``rows`` with the columns of ``values`` replaced by their totals from the group's first row to this one.

    ``group`` and ``values`` (name -> sum or xor) are columns of longs without nulls. Sums wrap at 64 bits. Rows should be a
    stored table, as ranges are found by a sample of it. An empty table stays empty.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, place = fresh(rows.columns, "part", "place")
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn(part, F.spark_partition_id())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, held = 0, None, {}
        for b in batches:
            if not b.num_rows:
                continue
            own = b[group].to_numpy()
            starts = np.append(0, np.flatnonzero(own[1:] != own[:-1]) + 1)
            run = np.zeros(len(own), np.int64)
            run[starts[1:]] = 1
            run = np.cumsum(run)
            columns = {n: b[n] for n in b.schema.names}
            for name, how in values.items():
                total = _totals(b[name].to_numpy(), starts, run, how)
                if last == own[0]:
                    first = total[: starts[1] if len(starts) > 1 else len(total)]
                    first[:] = first + held[name] if how == "sum" else first ^ held[name]
                columns[name], held[name] = pa.array(total), total[-1]
            last = own[-1]
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.arange(seen, seen + len(own)))], names=[*columns, place])
            seen += len(own)

    schema = T.StructType([*dealt.schema.fields, T.StructField(place, T.LongType())])
    local = stored(dealt.mapInArrow(scan, schema), tag)
    ends = local.groupBy(part).agg(F.min_by(group, place).alias("first"), F.max_by(F.struct(group, *values), place).alias("last")).collect()
    carried, held = [], None
    for r in sorted(ends, key=lambda r: r[part]):
        own = {n: r["last"][n] for n in values}
        if held and held[0] == r["first"]:
            carried.append((r[part], r["first"], *held[1].values()))
            if r["last"][group] == r["first"]:
                own = {n: _ADD[how](own[n], held[1][n]) for n, how in values.items()}
        held = (r["last"][group], own)
    at, of, *more = fresh(local.columns, "at", "of", *(f"more_{i}" for i in range(len(values))))
    extra = spark.createDataFrame(carried, f"{at} int, {of} long, " + ", ".join(f"{m} long" for m in more))
    both = local.join(F.broadcast(extra), (F.col(part) == F.col(at)) & (F.col(group) == F.col(of)), "left")
    whole = {n: F.coalesce(F.col(m), F.lit(0)) for n, m in zip(values, more)}
    joined = {n: F.col(n) + whole[n] if how == "sum" else F.col(n).bitwiseXOR(whole[n]) for n, how in values.items()}
    return both.select(*(joined[c].alias(c) if c in joined else c for c in rows.columns))
