"""Retrieval metrics and corpus inventories as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inclusive upper bounds of file sizes.
SIZE_BANDS = (("0-4KiB", 4 << 10), ("4-16KiB", 16 << 10), ("16-64KiB", 64 << 10), ("64-256KiB", 256 << 10))
LAST_BAND = "256KiB-1MiB"
#: Kinds of declarations; others are counted together.
KINDS = ("function", "class", "interface", "type", "enum")


# --- inventories -----------------------------------------------------------------------------------


def size_band(size: Column) -> Column:
    return F.coalesce(*(F.when(size <= most, name) for name, most in SIZE_BANDS), F.lit(LAST_BAND))


def path_patterns(path: Column) -> Column:
    """The pattern buckets a path falls in; several may apply. The stem is the name without its last extension."""
    folders = F.regexp_extract(F.lower(path), r"^(.*/)?", 0)
    stem = F.regexp_replace(F.regexp_extract(F.lower(path), r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    test = folders.rlike(r"(^|/)(test|tests|__tests__)/") | stem.rlike(r"^test_|(_test|\.test|\.spec)\z")
    migration = folders.rlike(r"(^|/)migrations?/")
    config = stem.rlike(r"^config(uration)?\z|\.config\z")
    return F.array_compact(F.array(F.when(test, "test"), F.when(migration, "migration"), F.when(config, "permitted_configuration")))


def counts_by(rows: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """(key, n[, bytes]) per value."""
    measures = [F.count("*").alias("n"), *([F.sum(size).alias("bytes")] if size is not None else [])]
    return rows.groupBy(key).agg(*measures)


def inventory(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(dimension, value, n, bytes) of a corpus, in one pass: files (path, language, size) and chunks (path, kind, text).

    Dimensions: extension, language, size_band, pattern (a file may have several), kind (of chunks with a declaration; other for
    an unknown one), chunks (all, bytes of their texts), files and files_without_symbols. Chunks are added up by file, as a file's
    kinds tell whether it has any, and both sides give rows of one stack, which is grouped once.
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    row = lambda dimension, value, n=F.lit(1).cast("long"), size=F.lit(0).cast("long"): F.struct(F.lit(dimension).alias("dimension"), value.cast("string").alias("value"), n.alias("n"), size.alias("bytes"))
    size = F.col("size").cast("long")
    one = F.lit(1).cast("long")
    single = [row("files", F.lit(""), one, size), row("extension", extension, one, size), row("language", F.col("language"), one, size), row("size_band", size_band(F.col("size")), one, size)]
    of_files = files.select(F.explode(F.concat(F.array(*single), F.transform(path_patterns(F.col("path")), lambda p: row("pattern", p, one, size)))).alias("r"))
    kinds = (*KINDS, "other")
    named = F.when(F.col("kind").isin(*KINDS), F.col("kind")).when(F.col("kind") != "", F.lit("other"))
    own = chunks.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size"), *(F.count_if(named == k).alias(k) for k in kinds))
    symbols = sum((F.col(k) for k in kinds), F.lit(0).cast("long"))
    of_chunks = own.select(F.explode(F.array(row("chunks", F.lit(""), F.col("n"), F.col("size")), row("files_with_symbols", F.lit(""), (symbols > 0).cast("long")), *(row("kind", F.lit(k), F.col(k)) for k in kinds))).alias("r"))
    total = of_files.unionByName(of_chunks).select("r.*").groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    # what is left of the files' row when those with symbols are taken off: both are rows of the result already
    last = F.col("dimension").isin("files", "files_with_symbols")
    without = total.where(last).agg(F.sum(F.when(F.col("dimension") == "files", F.col("n")).otherwise(-F.col("n"))).alias("n"))
    without = without.select(F.lit("files_without_symbols").alias("dimension"), F.lit("").alias("value"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(0).cast("long").alias("bytes"))
    return total.where("n > 0 AND dimension <> 'files_with_symbols'").unionByName(without)


def exact_symbol_cases(chunks: DataFrame, limit: int) -> DataFrame:
    """(query, first_id): one case per symbol name, names in the order of their smallest chunk id."""
    named = chunks.where(F.col("symbol_name") != "").groupBy(F.col("symbol_name").alias("query"))
    return named.agg(F.min("chunk_id").alias("first_id")).orderBy("first_id").limit(limit)


def symbol_chunks(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """(query, chunk_id): every chunk of the cases' names, a row each; a name of any number of chunks lies in as many tasks."""
    return chunks.select(F.col("symbol_name").alias("query"), "chunk_id").join(cases.select("query"), "query")


# --- metrics -----------------------------------------------------------------------------------------


def judged(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """hits (case_id, rank, chunk_id) with relevance, 0 where there is no judgment."""
    return hits.join(qrels, ["case_id", "chunk_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def _gain(relevance: Column) -> Column:
    return F.pow(F.lit(2.0), relevance) - 1.0


def ideal_gains(qrels: DataFrame, depth: int = 10) -> DataFrame:
    """(case_id, n_relevant, ideal): the best discounted gain that a case allows."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("relevance"), "chunk_id"))
    ranked = qrels.where("relevance > 0").withColumn("place", place)
    part = F.when(F.col("place") <= depth, _gain(F.col("relevance")) / F.log2(F.col("place") + 1.0)).otherwise(0.0)
    return ranked.groupBy("case_id").agg(F.count("*").alias("n_relevant"), F.sum(part).alias("ideal"))


def case_metrics(cases: DataFrame, hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per relevant case: recall_5, recall_10, mrr_10, ndcg_10.

    cases: (case_id, ..); hits: (case_id, rank from 1, chunk_id); qrels: (case_id, chunk_id, relevance 1..3).
    """
    found = F.col("relevance") > 0
    within = lambda k: F.sum((found & (F.col("rank") <= k)).cast("long"))
    per_case = judged(hits.where("rank <= 10"), qrels).groupBy("case_id").agg(
        within(5).alias("n5"), within(10).alias("n10"), F.min(F.when(found, F.col("rank"))).alias("first"),
        F.sum(F.when(found, _gain(F.col("relevance")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"))
    rows = cases.select("case_id", *(c for c in cases.columns if c != "case_id")).join(ideal_gains(qrels), "case_id").join(per_case, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        *cases.columns, zero(F.col("n5") / F.col("n_relevant")).alias("recall_5"), zero(F.col("n10") / F.col("n_relevant")).alias("recall_10"),
        zero(1.0 / F.col("first")).alias("mrr_10"), zero(F.col("gain") / F.col("ideal")).alias("ndcg_10"))


def category_metrics(per_case: DataFrame) -> DataFrame:
    return per_case.groupBy("category").agg(F.count("*").alias("cases"), *(F.avg(c).alias(c) for c in ("recall_5", "recall_10", "mrr_10", "ndcg_10")))


def no_evidence_accuracy(runs: DataFrame) -> Column:
    """Of (n_first, n_second) per case without relevant chunks: the share that is empty in both runs."""
    return F.avg(F.when((F.col("n_first") == 0) & (F.col("n_second") == 0), 1.0).otherwise(0.0))


def citation_validity(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(hits, valid, validity): hits that are a chunk in all of its columns that they have; 1 if there is no hit."""
    keys = [c for c in ("chunk_id", "path", "start_line", "end_line", "language", "symbol_name", "text") if c in hits.columns and c in chunks.columns]
    found = hits.join(chunks.select(*keys).withColumn("known", F.lit(1)), keys, "left")
    counted = found.agg(F.count("*").alias("hits"), F.count("known").alias("valid"))
    return counted.withColumn("validity", F.when(F.col("hits") == 0, 1.0).otherwise(F.col("valid") / F.col("hits")))


def determinism(first: DataFrame, second: DataFrame) -> DataFrame:
    """(cases, same, rate) over (case_id, rank, chunk_id) of two runs; a run's order is the list of its ids."""
    listed = lambda df, name: df.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(name))
    both = listed(first, "a").join(listed(second, "b"), "case_id", "full_outer")
    counted = both.agg(F.count("*").alias("cases"), F.coalesce(F.sum(F.col("a").eqNullSafe(F.col("b")).cast("long")), F.lit(0)).alias("same"))
    return counted.withColumn("rate", F.when(F.col("cases") == 0, 1.0).otherwise(F.col("same") / F.col("cases")))


def latency_percentiles(value: str) -> list[Column]:
    """Nearest-rank p50 and p95."""
    return [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in (0.5, 0.95)]


def resolve_judgments(judgments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, path, start_line, end_line, relevance, matches, chunk_id): each must match exactly one chunk."""
    keys = ["path", "start_line", "end_line"]
    own = chunks.groupBy(*keys).agg(F.count("*").alias("matches"), F.min("chunk_id").alias("chunk_id"))
    return judgments.join(own, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
