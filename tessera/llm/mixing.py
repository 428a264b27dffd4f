"""Mixing sources to target weights, in DataFrame operations only.

The words of each source are added up, and the corpus's total is shared among the sources by weight. No source may be
repeated more than ``MOST`` times: a target above that stops there, and what is over is shared among the others by weight, until
none is above. That is a loop over the table of sources: each round adds up the sources that stop and the weights of the
others, and the driver sees these two numbers. Sums and comparisons are of integers and decimals, so a tie is one.

A source's repetition rate is its target over its size. A document is emitted floor(rate) times, and once more if a hash of its id,
seeded and read as a number from 0 to 1, is below the rate's fraction. So every document's expected number of copies is the rate,
documents are decided apart from each other, and reruns agree.

Texts are read once, for their sizes; what is shuffled is a partial sum a source and task. The table of sources has a
row a source: its rank is found by ranges and offsets, and it's joined by ``join_spread``, which sends the rows of
sources with over a thousandth of all documents nowhere. So neither many sources nor a hot one meets in a task.

Defined cases: a null text has no words; documents without words are emitted like the others of their source and take none; a source
without any word has target and rate 0; null is a source of its own, the last; an empty source name is one too; a null
id is decided by its text; rows of equal ids are decided alike; a document of negative or repeated id is one like any other; very long
texts count whole; an empty table gives an empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import fresh
from tessera.llm.components import join_spread
from tessera.operators.ordinals import numbered
from tessera.session import stored

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 12
_WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of a draw: a double holds 52 bits.
_DIGITS = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def key(source: Column) -> Column:
    """A source as a key without nulls; the null one is the empty text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1 by the document's id, or its text where there is none."""
    name = F.coalesce(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), F.concat(F.lit(f"{seed}-"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def level(sources: DataFrame, most: int = MOST) -> tuple[int, int]:
    """(words, weight): what a weight of 1 gets, as a fraction. sources: (weight, size)."""
    target, room = F.lit(0), _whole(F.col("size") * most)
    stops = lambda words, weight: room * F.lit(weight).cast("decimal(19,0)") < F.col("weight").cast("decimal(10,0)") * F.lit(words).cast("decimal(25,0)")
    words, weight = sources.agg(F.sum(_whole(F.col("size"))), F.sum("weight")).first()
    now = (int(words or 0), int(weight or 1))
    total, before = now[0], None
    while now != before:
        before = now
        stop = stops(*now)
        used, left = sources.agg(F.sum(F.when(stop, room).otherwise(target)), F.sum(F.when(~stop, F.col("weight")).otherwise(0))).first()
        now = (total - int(used or 0), int(left or 1))
    return now


def rates(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, weight, documents, source_size, target, whole, part), a row a source. sizes: (source, size) of all documents.

    The weights go to the sources in the order of their names' code points, null last, over and over.
    """
    own = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("size"))
    ranked = numbered(own, F.asc_nulls_last("source"), name="rank")
    weight = F.get(F.array(*(F.lit(int(w)) for w in weights)), (F.col("rank") % len(weights)).cast("int"))
    sources = stored(ranked.select(key(F.col("source")).alias("key"), weight.alias("weight"), "documents", "size"), "sources")
    words, per = level(sources, most)
    size, share = _whole(F.col("size")), F.col("weight").cast("decimal(10,0)") * F.lit(words).cast("decimal(25,0)")
    stops = _whole(F.col("size") * most) * F.lit(per).cast("decimal(19,0)") <= share
    room = size.cast("decimal(19,0)") * F.lit(per).cast("decimal(19,0)")
    repeats = F.when(F.col("size") == 0, 0).when(stops, most).otherwise(F.floor(F.try_divide(share.cast("double"), room.cast("double"))))
    rest = F.when(stops | (F.col("size") == 0), 0.0).otherwise(F.try_divide((share - F.col("whole").cast("decimal(10,0)") * room).cast("double"), room.cast("double")))
    target = F.when(stops, (F.col("size") * most).cast("double")).otherwise(share.cast("double") / F.lit(float(per)))
    return sources.withColumn("whole", repeats.cast("long")).select("key", "weight", "documents", F.col("size").alias("source_size"), target.alias("target"), "whole", rest.alias("part"))


def repeated(rows: DataFrame, sources: DataFrame, decided: Column) -> DataFrame:
    """``rows`` (source, ..) with ``source_size``, ``target`` and ``copies``, under names that no column of theirs has: the last three."""
    k, n, whole, part, size, target, copies = fresh(rows.columns, "key", "n", "whole", "part", "source_size", "target", "copies")
    one = sources.select(F.col("key").alias(k), F.col("documents").alias(n), F.col("source_size").alias(size), F.col("target").alias(target), F.col("whole").alias(whole), F.col("part").alias(part))
    total = sources.agg(F.sum("documents")).first()[0] or 0
    both = join_spread(rows.withColumn(k, key(F.col("source"))), one, [k], n, total)
    return both.withColumn(copies, F.col(whole) + (decided < F.col(part)).cast("long")).select(*rows.columns, size, target, copies)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document (doc_id, text, source, ..) as often as the mix takes it, with its columns."""
    sources = rates(docs.select("source", n_words(F.col("text")).alias("size")), weights, most)
    out = repeated(docs, sources, draw(F.col("doc_id"), F.col("text"), seed))
    copies = out.columns[-1]
    return out.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken)."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("drawn"))
    rows = stored(rows, "sizes")
    out = repeated(rows, rates(rows), F.col("drawn"))
    size, target, copies = out.columns[-3:]
    return out.select("doc_id", "size", F.col(size).alias("source_size"), F.col(target).alias("target"), (F.col("size") * F.col(copies)).alias("taken"))


#: A source stops if its room is no more than its share of what is left to it and those with more room to their weight.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
  ('0x' || left(md5(coalesce('{SEED}:' || doc_id::VARCHAR, '{SEED}-' || coalesce(text, ''))), {_DIGITS}))::BIGINT / {float(16**_DIGITS)!r}::DOUBLE AS drawn FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS size, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::HUGEINT AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {MOST} * size / weight, source NULLS LAST) AS place FROM s),
c AS (SELECT *, (sum(size) OVER ())::HUGEINT - {MOST} * coalesce(sum(size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS words,
  (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS weights FROM o),
stop AS (SELECT *, {MOST} * size * weights <= weight * words AS stops FROM c),
first AS (SELECT words, weights AS per FROM stop WHERE NOT stops ORDER BY place LIMIT 1),
r AS (SELECT source, size, CASE WHEN stops THEN ({MOST} * size)::DOUBLE ELSE (weight * f.words)::DOUBLE / f.per::DOUBLE END AS target,
  CASE WHEN size = 0 THEN 0 WHEN stops THEN {MOST} ELSE (weight * f.words) // (f.per * size) END AS whole,
  CASE WHEN size = 0 OR stops THEN 0.0::DOUBLE ELSE ((weight * f.words) % (f.per * size))::DOUBLE / (f.per * size)::DOUBLE END AS part FROM stop LEFT JOIN first f ON true)
SELECT doc_id, d.size, r.size::BIGINT AS source_size, target, (d.size * (whole + (drawn < part)::BIGINT))::BIGINT AS taken FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
