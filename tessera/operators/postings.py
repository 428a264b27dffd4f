"""Lexical search over an inverted table.

A posting says that a token stands in a field of a chunk, with the columns that filter and order hits. The table lies in the order
of tokens, each file a range of it, so a query reads the pages of its own terms and nothing else; a token of very many chunks lies in
several files. Scores count presence only, so a list of postings adds the same weight to each of its chunks.

That bounds what a long list can do. The lists of a query are counted first. Where the short ones alone may settle it, the
long ones aren't read: what they could add is one number, and the few chunks that it could carry to the top are completed from the
chunks themselves, by their ids. If the last of the best is then above all that the long lists could give a chunk that stands in
no short one, the answer is exact; otherwise all lists are read. Either way the rows are those of ``lexical_search``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import checked, matches
from tessera.model import Filter, InvalidQuery
from tessera.operators.search import LEXICAL_ORDER, PATH_WEIGHT, SYMBOL_WEIGHT, TEXT_WEIGHT, WINDOW_MOST, lexical_score, query_terms

FIELDS = (("text", TEXT_WEIGHT), ("symbol", SYMBOL_WEIGHT), ("path", PATH_WEIGHT))
#: Long lists are left out if the others have no more than this part of all postings.
SHORT_PART = 0.25
_MARKS = 20  # terms whose marks fit a long


def postings(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """(token, field, path, start_line, chunk_id, language) of chunks with stored tokens, in the table's order; to be written once."""
    each = [_standing(name, k) for k, (name, _) in enumerate(FIELDS)]
    rows = chunks.select(F.explode(F.concat(*each)).alias("p"), *LEXICAL_ORDER, "language").select("p.*", *LEXICAL_ORDER, "language")
    order = ["token", "field", *LEXICAL_ORDER]
    parts = parts or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _standing(name: str, field: int) -> Column:
    return F.transform(f"{name}_tokens", lambda t: F.struct(t.alias("token"), F.lit(field).alias("field")))


def _of(lists: Sequence[tuple[str, int]]) -> Column:
    """Rows of some lists; plain comparisons, which reach the files."""
    by: dict[str, list[int]] = {}
    for token, field in lists:
        by.setdefault(token, []).append(field)
    parts = [(F.col("token") == t) & (F.lit(True) if len(f) == len(FIELDS) else F.col("field").isin(f)) for t, f in by.items()]
    return reduce(Column.__or__, parts, F.lit(False))


def _weights(terms: Sequence[str], marks: Sequence[Column]) -> Column:
    """The weights of what is marked, added term by term, in the query's order."""
    score = F.lit(0.0)
    for i, _ in enumerate(terms):
        for k, (_, weight) in enumerate(FIELDS):
            bit = F.lit(1 << (i % _MARKS * len(FIELDS) + k)).cast("long")
            score = score + F.when(marks[i // _MARKS].bitwiseAND(bit) != 0, F.lit(weight)).otherwise(F.lit(0.0))
    return score / F.lit(float(len(terms)))


def _scored(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(path, start_line, chunk_id, score) by the postings given."""
    place = F.coalesce(*(F.when(F.col("token") == t, F.lit(i)) for i, t in enumerate(terms)))
    rows = rows.withColumn("i", place)
    words = range(-(-len(terms) // _MARKS))
    bit = F.expr(f"shiftleft(1L, i % {_MARKS} * {len(FIELDS)} + field)")
    own = [F.bit_or(F.when(F.floor(F.col("i") / _MARKS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"marks_{w}") for w in words]
    found = rows.groupBy(*LEXICAL_ORDER).agg(*own)
    return found.select(*LEXICAL_ORDER, _weights(terms, [F.col(f"marks_{w}") for w in words]).alias("score"))


def _with_ids(chunks: DataFrame, ids: Sequence[str]) -> DataFrame:
    return chunks.where(F.col("chunk_id").isin(list(ids)))


def _by_short(chunks: DataFrame, rows: DataFrame, terms: Sequence[str], lists: dict, limit: int) -> list | None:
    """The best ids with their scores, if the short lists settle them."""
    ordered = sorted(lists, key=lambda x: (lists[x], x))
    total, short, seen = sum(lists.values()), [], 0
    for one in ordered:
        if seen + lists[one] > SHORT_PART * total:
            break
        short.append(one)
        seen += lists[one]
    left = [one for one in ordered if one not in short]
    if seen < limit or not left:
        return None
    # the sum of floats in another order may be off by its last bits
    rest = sum(FIELDS[field][1] for _, field in left) / len(terms) * (1 + 1e-12)
    own = _scored(rows.where(_of(short)), terms)
    some = own.orderBy(F.desc("score"), *LEXICAL_ORDER).limit(WINDOW_MOST + 1).collect()
    if len(some) < limit:
        return None
    least = some[limit - 1]["score"]  # of the best by short lists alone, which more lists only raise
    if some[-1]["score"] + rest >= least and len(some) > WINDOW_MOST:
        return None  # more may reach the top than are looked at one by one
    few = [r["chunk_id"] for r in some if r["score"] + rest >= least]
    whole = _with_ids(chunks, few).select(*LEXICAL_ORDER, lexical_score(terms).alias("score")).orderBy(F.desc("score"), *LEXICAL_ORDER).limit(limit).collect()
    return [(r["chunk_id"], r["score"]) for r in whole] if len(whole) == limit and whole[-1]["score"] > rest else None


def search(chunks: DataFrame, table: DataFrame, text: str, limit: int = 10, wanted: Filter = Filter(), languages: Sequence[str] | None = None, repository_id: str = "repository") -> DataFrame:
    """``lexical_search`` by a stored table of ``postings``: the best ``limit`` chunks with a score above 0, in order."""
    if not repository_id or not repository_id.strip() or limit <= 0:
        raise InvalidQuery("invalid lexical query")
    terms = query_terms(chunks.sparkSession, text)
    checked(wanted, languages)
    rows = table.where(_of([(t, k) for t in terms for k in range(len(FIELDS))])).where(matches(wanted))
    order = [F.desc("score"), *LEXICAL_ORDER]
    if limit > WINDOW_MOST:
        best = _scored(rows, terms).orderBy(*order).limit(limit).select("chunk_id", "score")
        return chunks.join(best, "chunk_id").select(*chunks.columns, "score").orderBy(*order)
    lists = {(r["token"], r["field"]): r["n"] for r in rows.groupBy("token", "field").agg(F.count("*").alias("n")).collect()}  # three a term at most
    found = _by_short(chunks, rows, terms, lists, limit)
    if found is None:
        found = [(r["chunk_id"], r["score"]) for r in _scored(rows, terms).orderBy(*order).limit(limit).collect()]
    best = chunks.sparkSession.createDataFrame(found, "chunk_id string, score double")
    return _with_ids(chunks, [i for i, _ in found]).join(F.broadcast(best), "chunk_id").select(*chunks.columns, "score").orderBy(*order)
