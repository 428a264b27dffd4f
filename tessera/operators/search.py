"""Ranked retrieval over chunk and vector frames.

Every searcher filters before it scores and ends in a total order with a limit, which Spark runs as one
top-k per partition and a merge of k rows each; nothing is sorted or shuffled whole. The hybrid searcher joins two
such results of at most ``WINDOW_MOST`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import bound, checked, matches, reference_ok, token_set
from tessera.model import EvidenceIntegrity, Filter, InvalidConfig, InvalidQuery, InvalidQueryVector, valid_reference

TEXT_WEIGHT, SYMBOL_WEIGHT, PATH_WEIGHT = 0.6, 0.3, 0.1
MAX_HYBRID_LIMIT = 200
WINDOW_LEAST, WINDOW_MOST, WINDOW_TIMES = 20, 200, 4
RRF_K = 60
MAX_VECTOR_LIMIT = 2**31 - 1

#: Total orders, best first. The lexical one doesn't look at where a chunk ends.
LEXICAL_ORDER = ("path", "start_line", "chunk_id")
VECTOR_ORDER = ("path", "start_line", "end_line", "chunk_id")


def with_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks with the token arrays that the lexical searcher reads; compute once, when the index is built."""
    return chunks.withColumns({f"{c}_tokens": token_set(F.col(source)) for c, source in (("text", "text"), ("symbol", "symbol_name"), ("path", "path"))})


def query_terms(spark, text: str) -> list[str]:
    """Distinct tokens of a query, in order, by the same expression as the index; it is folded, so no job runs."""
    terms = spark.sql("VALUES (1)").select(token_set(F.lit(text)).alias("t")).first()["t"] if text and text.strip() else []
    if not terms:
        raise InvalidQuery("the query has no token")
    return list(terms)


# --- lexical ----------------------------------------------------------------------------------


def _fold(terms: Sequence[str], found) -> Column:
    """Sums the weights term by term, in the query's order, as the order decides the last bit."""
    score = F.lit(0.0)
    for i, _ in enumerate(terms):
        for field, weight in (("text", TEXT_WEIGHT), ("symbol", SYMBOL_WEIGHT), ("path", PATH_WEIGHT)):
            score = score + F.when(found(field, i), F.lit(weight)).otherwise(F.lit(0.0))
    return score / F.lit(float(len(terms)))


def lexical_score(terms: Sequence[str]) -> Column:
    """Over stored token arrays. Presence only: how often or rarely a term stands doesn't count."""
    return _fold(terms, lambda field, i: F.array_contains(f"{field}_tokens", terms[i]))


def lexical_score_of_text(terms: Sequence[str]) -> Column:
    """Over plain columns: each is cut into tokens once a row, whatever the number of terms."""
    hits = lambda source: bound(token_set(F.col(source)), lambda t: F.array(*(F.array_contains(t, x) for x in terms)))
    row = F.struct(*(hits(source).alias(field) for field, source in (("text", "text"), ("symbol", "symbol_name"), ("path", "path"))))
    return bound(row, lambda r: _fold(terms, lambda field, i: F.get(r[field], F.lit(i))))


def lexical_search(chunks: DataFrame, text: str, limit: int = 10, wanted: Filter = Filter(), languages: Sequence[str] | None = None, repository_id: str = "repository") -> DataFrame:
    """The best ``limit`` chunks with a score above 0, with the columns of ``chunks`` and score, in order."""
    if not repository_id or not repository_id.strip() or limit <= 0:
        raise InvalidQuery("invalid lexical query")
    terms = query_terms(chunks.sparkSession, text)
    checked(wanted, languages)
    score = lexical_score(terms) if "text_tokens" in chunks.columns else lexical_score_of_text(terms)
    scored = chunks.where(matches(wanted)).withColumn("score", score).where("score > 0")
    return scored.orderBy(F.desc("score"), *LEXICAL_ORDER).limit(limit)


#: Weights in the order in which a term's are added.
_FIELDS = (("text", TEXT_WEIGHT), ("symbol", SYMBOL_WEIGHT), ("path", PATH_WEIGHT))
#: Terms whose three marks each fit a long.
_TERMS_A_WORD = 20
#: Bytes of queries whose terms are broadcast; more are joined by a shuffle.
BATCH_BYTES = 8 << 20
#: Pairs of a chunk and a case, found or not, that one task may have to merge; of found ones it holds each, at up to about 200 bytes.
BATCH_PAIRS = 2_000_000
#: The same of matches alone, where terms are joined by a shuffle.
BATCH_MATCHES = 500_000


def _standing(tokens: str, field: int) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(field).alias("field")))


def lexical_batch(chunks: DataFrame, cases: DataFrame, limit: int = 10) -> DataFrame:
    """``lexical_search`` for many queries at once: (case_id, rank from 1, chunk_id, score) from cases (case_id, query).

    Chunks' stored tokens and the queries' terms are joined by term. What a case finds in a chunk is a mark a term and field, merged
    where the chunk lies, so that no match is shuffled (for queries of up to ``BATCH_BYTES``); the weights of the marks are added in the order of the query's terms, so scores are the same doubles. The
    best of each case are cut where they are before they are shuffled (WindowGroupLimit). Three jobs, however many cases (one more, which counts matches, where terms
    are joined by a shuffle); tasks that merge grow in number, not in what each holds. A case
    whose query has no token is an error; ids tell cases apart.
    """
    if limit <= 0:
        raise InvalidQuery("invalid lexical query")
    terms = cases.select("case_id", token_set(F.col("query")).alias("terms"), F.octet_length("query").alias("size"))
    least, most, size, n = terms.agg(F.min(F.size("terms")), F.max(F.size("terms")), F.sum("size"), F.count("*")).first()
    few = (size or 0) <= BATCH_BYTES
    if least == 0:
        raise InvalidQuery("a query has no token")
    words = range(-(-(most or 1) // _TERMS_A_WORD))
    terms = terms.select("case_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("i", "term"))
    dealt = chunks.select(*LEXICAL_ORDER, *(f"{field}_tokens" for field, _ in _FIELDS))
    least_parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if few:  # dealt by chunk before tokens meet terms: matches, of which there are far more than tokens, are then merged and cut where they lie
        parts = max(least_parts, -(-chunks.count() * n // BATCH_PAIRS))
        dealt, terms = dealt.repartition(parts, "chunk_id"), F.broadcast(terms)
    else:
        terms = terms.hint("merge")
    postings = dealt.select(*LEXICAL_ORDER, F.explode(F.concat(*(_standing(f"{field}_tokens", k) for k, (field, _) in enumerate(_FIELDS)))).alias("p")).select(*LEXICAL_ORDER, "p.*")
    mark = F.expr(f"shiftleft(1L, i % {_TERMS_A_WORD} * {len(_FIELDS)} + field)")
    own = [F.bit_or(F.when(F.floor(F.col("i") / _TERMS_A_WORD) == k, mark).otherwise(F.lit(0).cast("long"))).alias(f"marks_{k}") for k in words]
    met = postings.join(terms, "term")
    if not few:  # matches, counted first, are dealt evenly before they are merged
        each = lambda df, name: df.groupBy("term").agg(F.count("*").alias(name))
        matches = each(postings, "a").join(each(terms, "b"), "term").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        met = met.repartition(max(least_parts, -(-(matches or 0) // BATCH_MATCHES)), "case_id", "chunk_id")
    matched = met.groupBy("case_id", "n_terms", *LEXICAL_ORDER).agg(*own)
    weight = F.array(*(F.lit(w) for _, w in _FIELDS))
    score = F.lit(0.0)
    for k in words:
        step = lambda a, x, k=k: a + F.when(F.getbit(F.col(f"marks_{k}"), x) == 1, F.get(weight, x % len(_FIELDS))).otherwise(0.0)
        last = F.least(F.col("n_terms") - k * _TERMS_A_WORD, F.lit(_TERMS_A_WORD)) * len(_FIELDS) - 1
        places = F.when(last > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        score = F.aggregate(places, score, _two(step))
    scored = matched.select("case_id", *LEXICAL_ORDER, (score / F.col("n_terms").cast("double")).alias("score"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), *LEXICAL_ORDER))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit).select("case_id", "rank", "chunk_id", "score")


def _two(step):
    """A function of two columns only, as ``aggregate`` counts the parameters."""
    return lambda a, x: step(a, x)


# --- vectors -----------------------------------------------------------------------------------


def _squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def normalized(v: Column) -> Column:
    """To length 1: summed in double, stored in single precision. Null for a vector that can't be."""
    length = F.sqrt(_squares(v))
    usable = (length > 0) & (length < float("inf")) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(usable, bound(length, lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float"))))


def rescaled(v: Column) -> Column:
    """As ``normalized``, for components whose squares would overflow: divided by the largest first."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when((most > 0) & (most < float("inf")), bound(most, lambda m: normalized(F.transform(v, lambda x: x.cast("double") / m))))


def normalize_query(vector: Sequence[float], dimensions: int | None = None) -> list[float]:
    """The same for one query vector, on the driver."""
    import numpy as np

    v = np.asarray(vector, np.float64)
    if v.ndim != 1 or not len(v) or (dimensions is not None and len(v) != dimensions) or not np.isfinite(v).all():
        raise InvalidQueryVector("invalid query vector")
    v = v.astype(np.float32).astype(np.float64)
    length = math.sqrt(sum(float(x) * float(x) for x in v))
    if not 0 < length < math.inf:
        raise InvalidQueryVector("invalid query vector")
    return [float(x) for x in (v / length).astype(np.float32)]


def cosine(left: Column, right: Column) -> Column:
    """Dot product over the root of the product of the squared lengths, in double, in order; a last-bit excess over 1 is cut.
    Null for a vector of zeros, and where a component isn't finite."""
    dot = F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    value = F.try_divide(dot, F.sqrt(_squares(left) * _squares(right)))
    return bound(value, lambda c: F.when(F.isnan(c), F.lit(None)).when((c > 1) & (c <= 1 + 1e-12), 1.0).when((c < -1) & (c >= -1 - 1e-12), -1.0).otherwise(c))


#: Longer vectors are scored a batch at a time outside the JVM: its array functions aren't compiled, and take about
#: 100 ns a component. The sums run over the components in the same order, so both ways give the same doubles.
COMPILED_DIMENSIONS = 128
_COMPONENTS = 64


def cosine_batches(values: Column, query: Sequence[float]) -> Column:
    """``cosine`` with one fixed vector, for many rows at a time."""
    import numpy as np

    q = np.asarray(query, np.float32).astype(np.float64)

    @F.arrow_udf(T.DoubleType())
    def score(rows: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(rows), len(q)), False).to_numpy(zero_copy_only=False)
        vectors = (rows if fits.all() else rows.filter(pa.array(fits))).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q))
        dot, left, right = np.zeros(len(vectors)), np.zeros(len(vectors)), 0.0
        part = np.empty(len(vectors))
        for at in range(0, len(q), _COMPONENTS):  # a component of all vectors at a time, from a small copy where it lies together
            for x, y in zip(vectors[:, at : at + _COMPONENTS].T.astype(np.float64, order="C"), q[at : at + _COMPONENTS].tolist()):
                dot += np.multiply(x, y, out=part)
                left += np.multiply(x, x, out=part)
                right += y * y
        with np.errstate(invalid="ignore", divide="ignore"):
            found = dot / np.sqrt(left * right)
        found[(found > 1) & (found <= 1 + 1e-12)] = 1.0
        found[(found < -1) & (found >= -1 - 1e-12)] = -1.0
        out = np.full(len(rows), np.nan)
        out[fits] = np.where(left * right > 0, found, np.nan)
        return pa.array(out, mask=np.isnan(out))

    return score(values)


def vector_candidates(chunks: DataFrame, vectors: DataFrame, query: Sequence[float], limit: int, wanted: Filter = Filter(), languages: Sequence[str] | None = None) -> DataFrame:
    """The ``limit`` chunks most similar to a unit query vector; chunks with ``similarity``. vectors: (chunk_id, values), as stored ones
    with the columns that filter and order beside them; without these, only ids and similarities are joined with the chunks' keys.

    Vectors are scored where they are read; a vector without a similarity (zero, of another length, or with a component that isn't
    finite) is no candidate. Only keys go through the ranking, and texts are read for the best.
    """
    if not 0 < limit <= MAX_VECTOR_LIMIT:
        raise InvalidQuery("invalid vector limit")
    checked(wanted, languages)
    if len(query) > COMPILED_DIMENSIONS:
        similarity = cosine_batches(F.col("values"), query)
    else:
        similarity = cosine(F.col("values"), F.array(*(F.lit(float(x)).cast("float") for x in query)))
    if {*VECTOR_ORDER, "language"} <= {*vectors.columns}:
        place = ["ordinal"] if "ordinal" in vectors.columns and "ordinal" in chunks.columns else []
        scored = vectors.where(matches(wanted)).select(*VECTOR_ORDER, "language", *place, similarity.alias("similarity")).where("similarity IS NOT NULL")
    else:
        place = []
        scored = chunks.where(matches(wanted)).select(*VECTOR_ORDER).join(vectors.select("chunk_id", similarity.alias("similarity")).where("similarity IS NOT NULL"), "chunk_id")
    best = scored.orderBy(F.desc("similarity"), *VECTOR_ORDER).limit(limit)
    rest = [c for c in chunks.columns if c not in best.columns]
    if not rest:
        return best.select(*chunks.columns, "similarity")
    if limit > WINDOW_MOST:
        return best.select("chunk_id", "similarity").join(chunks, "chunk_id").select(*chunks.columns, "similarity")
    if place:  # few ordinals, known by now, reach the files, whose pages are in their order
        rows = best.select("chunk_id", "ordinal", "similarity").collect()
        chunks = chunks.where(reduce(Column.__or__, (F.col("ordinal") == r["ordinal"] for r in rows), F.lit(False)))
        best = chunks.sparkSession.createDataFrame([(r["chunk_id"], r["similarity"]) for r in rows], "chunk_id string, similarity double")
    return chunks.join(F.broadcast(best.select("chunk_id", "similarity")), "chunk_id").select(*chunks.columns, "similarity")


def vector_search(chunks: DataFrame, vectors: DataFrame, query: Sequence[float], limit: int = 10, wanted: Filter = Filter(), languages: Sequence[str] | None = None) -> DataFrame:
    """Candidates by raw similarity, then in the order of the score (similarity + 1) / 2, in which some may tie."""
    found = vector_candidates(chunks, vectors, query, limit, wanted, languages)
    return found.withColumn("score", (F.col("similarity") + 1.0) / 2.0).drop("similarity").orderBy(F.desc("score"), *VECTOR_ORDER)


def validated(hits: Sequence) -> Sequence:
    """Ranked rows, if each is evidence: an id and a text, a clean reference, a finite score, and no id twice."""
    for h in hits:
        if not h["chunk_id"] or not h["text"] or not valid_reference(h["path"] or "", h["start_line"] or 0, h["end_line"] or 0) or h["score"] is None or not math.isfinite(h["score"]):
            raise EvidenceIntegrity("invalid hit")
    if len({h["chunk_id"] for h in hits}) < len(hits):
        raise EvidenceIntegrity("one id is found twice")
    return hits


def hit_faults(hits: DataFrame) -> DataFrame:
    """(chunk_id, fault) of the hits of a table that ``validated`` would refuse; fault: id, text, reference, score or repeated, the first that holds."""
    sound = F.coalesce(reference_ok(F.col("path"), F.col("start_line"), F.col("end_line")), F.lit(False))
    score = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    fault = F.when(F.coalesce("chunk_id", F.lit("")) == "", "id").when(F.coalesce("text", F.lit("")) == "", "text").when(~sound, "reference").when(~score, "score")
    own = hits.select("chunk_id", fault.alias("fault")).where("fault IS NOT NULL")
    again = hits.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1 AND chunk_id <> ''").select("chunk_id", F.lit("repeated").alias("fault"))
    return own.unionByName(again)


# --- hybrid ----------------------------------------------------------------------------------------


def candidate_window(limit: int) -> int:
    """How many candidates each side gives for a limit of 1 to 200."""
    if not 1 <= limit <= MAX_HYBRID_LIMIT:
        raise InvalidQuery("invalid hybrid limit")
    return min(max(limit * WINDOW_TIMES, WINDOW_LEAST), WINDOW_MOST)


def fusion_settings(k: float = RRF_K, lexical_weight: float = 1.0, vector_weight: float = 1.0) -> tuple[float, float, float]:
    """Checked settings; 0 stands for the default."""
    values = (k or RRF_K, lexical_weight or 1.0, vector_weight or 1.0)
    if any(not math.isfinite(v) or v <= 0 for v in values):
        raise InvalidConfig("invalid fusion settings")
    k, wl, wv = values
    most = (wl + wv) / (k + 1)
    if not math.isfinite(most) or most <= 0 or min(wl, wv) / (k + MAX_HYBRID_LIMIT) / most <= 0:
        raise InvalidConfig("fusion contributions underflow")
    return k, wl, wv


def fuse(lexical: DataFrame, vector: DataFrame, limit: int, k: float = RRF_K, lexical_weight: float = 1.0, vector_weight: float = 1.0, check: bool = False) -> DataFrame:
    """Reciprocal rank fusion of two ranked results (chunks with score) of at most ``WINDOW_MOST`` rows.

    Only the ranks count. A full outer join by id; the result has score, contributors and best_rank. With
    ``check``, an id that stands for two different chunks is an error, and so is a score that isn't above 0 and at most 1.
    """
    k, wl, wv = fusion_settings(k, lexical_weight, vector_weight)
    shared = [c for c in lexical.columns if c in vector.columns and c not in ("score", "chunk_id")]
    side = lambda df, rank, order: df.select(F.struct(*shared).alias(f"{rank}_chunk"), "chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), *order)).alias(rank))
    both = side(lexical, "rl", LEXICAL_ORDER).join(side(vector, "rv", VECTOR_ORDER), "chunk_id", "full_outer")
    if check and both.where(~F.col("rl_chunk").eqNullSafe(F.col("rv_chunk")) & F.col("rl").isNotNull() & F.col("rv").isNotNull()).limit(1).count():
        raise EvidenceIntegrity("one id stands for two chunks")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    score = (part(wl, "rl") + part(wv, "rv")) / F.lit((wl + wv) / (k + 1))
    fused = both.select(
        "chunk_id", F.coalesce("rl_chunk", "rv_chunk").alias("c"), score.alias("score"),
        (F.col("rl").isNotNull().cast("int") + F.col("rv").isNotNull().cast("int")).alias("contributors"), F.least("rl", "rv").alias("best_rank"))
    flat = fused.select("chunk_id", *(f"c.{c}" for c in shared), "score", "contributors", "best_rank")
    if check:
        sound = F.coalesce((F.col("score") > 0) & (F.col("score") <= 1), F.lit(False))
        flat = flat.withColumn("score", F.when(sound, F.col("score")).otherwise(F.raise_error(F.lit("a fused score is out of range"))))
    return flat.orderBy(F.desc("score"), F.desc("contributors"), "best_rank", *VECTOR_ORDER).limit(limit)


def hybrid_search(chunks: DataFrame, vectors: DataFrame, text: str, query: Sequence[float], limit: int = 10, wanted: Filter = Filter(), languages: Sequence[str] | None = None, **settings) -> DataFrame:
    window = candidate_window(limit)
    lexical = lexical_search(chunks, text, window, wanted, languages)
    return fuse(lexical, vector_search(chunks, vectors, query, window, wanted, languages), limit, **settings)


def fallback(lexical: DataFrame, limit: int) -> DataFrame:
    """What a hybrid query gives without its semantic side: lexical hits with lexical scores."""
    return lexical.orderBy(F.desc("score"), *LEXICAL_ORDER).limit(limit)
