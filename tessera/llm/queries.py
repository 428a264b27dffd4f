"""The operators' queries, as the driver calls them, and their SQL."""

from __future__ import annotations

from tessera.llm import collocations, decontaminate, embedding_dedup, language_id, license_scan, line_dedup, mixing, piece_dropout, prefix_trie, resample, simhash, token_files, url_filter
from tessera.session import table


def op1_simhash(spark, sf_dir):
    return simhash.query(table(spark, sf_dir, "documents"))


def op2_token_files(spark, sf_dir):
    return token_files.query(table(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return license_scan.query(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return url_filter.query(table(spark, sf_dir, "pages"))


def op5_language_id(spark, sf_dir):
    return language_id.query(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.query(table(spark, sf_dir, "embeddings"))


def op9_resample(spark, sf_dir):
    return resample.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_piece_dropout(spark, sf_dir):
    return piece_dropout.query(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.query(table(spark, sf_dir, "documents"))


def op12_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.query(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_token_files, op3_license_scan, op4_url_filter, op5_language_id, op6_decontaminate, op7_line_dedup, op8_embedding_dedup, op9_resample, op10_piece_dropout, op11_collocations, op12_mixing, op13_prefix_trie)
}
ORACLES = {"op3_license_scan": license_scan.ORACLE_SQL, "op7_line_dedup": line_dedup.ORACLE_SQL, "op8_embedding_dedup": embedding_dedup.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_mixing": mixing.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
