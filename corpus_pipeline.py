"""A training corpus from ``documents``, in five stages, each one of the package's operators.

1. language ID: documents without a language go, and those that don't read like any learned language
   (``language_id.Usual``); a missing ``lang`` is filled in.
2. line dedup: lines of ten documents or more go from every text.
3. SimHash near-dedup on five-word shingles: of each group of near copies the document of the smallest id stays.
4. benchmark decontamination: documents that hold a test item go.
5. SentencePiece encoding with seeded merge-dropout, decoded again: ids, their number, and whether they decode
   to the text.

Every stage but the last returns the columns of ``documents``, with ``n_chars`` kept true. Null and empty texts have no
language and go in stage 1; repeated rows go through all stages alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, line_dedup, piece_dropout, simhash
from tessera.session import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The ring on the first 64 bits finds candidates; the whole sketch of 512 bits decides. Texts that share 0.8 of their
#: shingles differ in 78 of 512 bits on average, give or take 8, and in at most 14 of 64 in 97 cases of 100.
SHINGLE, NEAR_BITS, SKETCH_WORDS, SKETCH_BITS = 5, 14, 8, 84


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = language_id.examples(docs)
    net = language_id.train(learned)
    kept = language_id.label(docs, net, language_id.Usual(learned, net)).where("usual")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, shingle=SHINGLE, max_bits=NEAR_BITS, sketch_words=SKETCH_WORDS, max_sketch_bits=SKETCH_BITS).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_dropout.encode(docs.select("doc_id", "lang", "text"), model)
    return rows.select("doc_id", "lang", "ids", "n_pieces", "lossless")


STAGES = [
    ("language_id", detect_language),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("piece_dropout", encode_pieces),
]

#: No SQL has the network, the fingerprints or the segmentations; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
