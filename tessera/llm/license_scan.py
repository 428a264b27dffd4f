"""License scans by diagonal voting, in DataFrame operations only.

Every run of ``K`` words of every text is hashed and joined with the places of such runs in the templates. A
match at word i of the text and word j of the template lies on the diagonal i - j; an unbroken copy puts all its
matches on one diagonal. Matches are counted by document, template and diagonal before anything is shuffled.

Words put in or left out move the rest of a copy to a neighbouring diagonal. So from each diagonal on, those up to
the template's reach further (about ``STRETCH`` - 1 of its length) are merged, and what they hold is verified: it counts for its
template if at least ``COVER`` of the template's runs stand there. A copy word for word has all of them on its own
diagonal, so nothing that stands around it can hide it. Of overlapping spans of one template the best one is
returned: that of the highest score, then of most matches on its first diagonal, then the first.

A phrase stands at a place when its diagonal has a match for each of its runs: the join compares the words
themselves too, so that is the phrase word for word.

The templates are a fixed list, so the join's small side is broadcast. A document sends one row more, which
carries its number of words, so texts are read once and never shuffled.

Defined cases: a null or empty text has no words, no labels and the score 0; repeated rows and ids are scanned one by
one (rows are told apart by where they are in the input, not by id); a text shorter than a run matches nothing; ties
and overlaps of templates all count; very long texts are scanned whole; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
#: The part of a template's runs that a span must hold, and about how many times as long it may be.
COVER = 0.75
STRETCH = 1.5

# The phrases of the base labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Notices that the method labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, lower-cased.

    Only letters of ASCII decide what matches a template, and ``lower`` makes such letters of two others only:
    texts with these take the slower way.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.contains("\u0130") | text.contains("\u212a"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def reach(length: int) -> int:
    """How many diagonals after its first a copy of a template may use: the power of two in (``STRETCH`` - 1) of its length."""
    return 1 << max(0, int((STRETCH - 1) * length).bit_length() - 1)


_TABLE = ", ".join(f"t{k} string" for k in range(K)) + ", template int, tpos int, base boolean, label string, length int, step int"


def _templates(spark, phrases, templates) -> DataFrame:
    """A row per run of each phrase and template: its words, its place, and what it belongs to. ``step`` stretches diagonals so
    that every template's reach is the same. The first row is for the documents themselves."""
    rows: list[tuple] = [(*[""] * K, -1, 0, False, "", 0, 1)]
    texts = [*((True, *x) for x in phrases), *((False, *x) for x in templates)]
    widest = max((reach(len(text.split())) for *_, text in texts), default=1)
    for t, (base, label, text) in enumerate(texts):
        own = text.split()
        if len(own) < K or not text.isascii():
            raise ValueError(f"{text!r} isn't ASCII or is shorter than {K} words")
        rows += [(*own[j : j + K], t, j, base, label, len(own), widest // reach(len(own))) for j in range(len(own) - K + 1)]
    return spark.createDataFrame(rows, _TABLE).withColumn("thash", F.xxhash64(*(f"t{k}" for k in range(K))))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, cover: float = COVER) -> DataFrame:
    """(rid, doc_id, n_words, spans): spans are array<struct<first, last, base, label, score>> by place."""
    own = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words(F.col("text")).alias("w")).select("*", F.size("w").alias("n_words"))
    # one row before the first word stands for the document itself
    places = own.select("rid", "doc_id", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.col("n_words") - K))).alias("pos"))
    gram = [F.get("w", F.col("pos") + k) for k in range(K)]
    runs = places.select("rid", "doc_id", "n_words", "pos", *(F.when(F.col("pos") < 0, F.lit("")).otherwise(g).alias(f"g{k}") for k, g in enumerate(gram)))
    runs = runs.withColumn("hash", F.xxhash64(*(f"g{k}" for k in range(K))))
    same = [F.col("hash") == F.col("thash"), *(F.col(f"g{k}") == F.col(f"t{k}") for k in range(K))]
    hits = runs.join(F.broadcast(_templates(docs.sparkSession, phrases, templates)), same)
    document = ["rid", "doc_id", "n_words"]
    keys = [*document, "template", "base", "label", "length", "step"]
    # at most one match per run of the template on a diagonal, so the lists are short
    votes = hits.groupBy(*keys, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_list("tpos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    widest = max((reach(len(text.split())) for _, text in (*phrases, *templates)), default=1)
    line = F.col("diagonal").cast("long") * F.col("step")
    by = Window.partitionBy("rid", "template").orderBy("line")
    ahead = by.rangeBetween(0, widest)
    # a phrase is one diagonal; a template's copy is a diagonal and those in its reach
    near = lambda c, f: F.when(F.col("base"), F.col(c)).otherwise(f(c).over(ahead))
    merged = F.when(F.col("base"), F.col("held")).otherwise(F.array_distinct(F.flatten(F.collect_list("held").over(ahead))))
    spans = votes.withColumn("line", line).select(*keys, "line", F.size("held").alias("votes"), F.size(merged).alias("covered"), near("first", F.min).alias("first"), (near("last", F.max) + (K - 1)).alias("last"))
    runs_in = F.col("length") - (K - 1)
    whole = F.when(F.col("base"), F.col("covered") == runs_in).otherwise(F.col("covered") >= F.ceil(F.lit(cover) * runs_in))
    spans = spans.where((F.col("template") < 0) | whole)
    worth = F.struct("covered", "votes", (-F.col("line")).alias("before"))
    best = F.when(F.col("base") | (F.col("template") < 0), F.lit(True)).otherwise(worth == F.max(worth).over(by.rangeBetween(-widest, widest)))
    spans = spans.withColumn("best", best).where("best")
    found = F.when(F.col("template") >= 0, F.struct("first", "last", "base", "label", (F.col("covered") / runs_in).alias("score")))
    return spans.groupBy(*document).agg(F.sort_array(F.collect_list(found)).alias("spans"))


def labels(spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    base = F.filter("spans", lambda s: s.base)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s.label))), ",")
    start = F.transform(base, lambda s: s.first.cast("long"))
    return spans.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"))


def query(docs: DataFrame) -> DataFrame:
    return labels(scan(docs.select("doc_id", "text")))


def _oracle() -> str:
    """The same columns from plain lists of words: places of phrases by comparing words, and for each template the most of
    its runs that stand on any diagonal and those in its reach."""
    rows = [(True, *p, 0) for p in PHRASES] + [(False, *t, reach(len(t[1].split()))) for t in TEMPLATES]
    values = ", ".join(f"({i}, {str(base).lower()}, '{label}', '{text}', {r})" for i, (base, label, text, r) in enumerate(rows))
    return rf"""
WITH t AS (SELECT tid, base, label, string_split(txt, ' ') AS tw, len(string_split(txt, ' ')) AS n, r FROM (VALUES {values}) v(tid, base, label, txt, r)),
tg AS (SELECT *, unnest(range(1, n - {K - 2})) AS j FROM t WHERE NOT base),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d),
places AS (SELECT rid, i - 1 AS i, label FROM p JOIN t ON base AND w[i] = tw[1] AND w[i : i + n - 1] = tw),
based AS (SELECT rid, count(*) AS n_base, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS b FROM places GROUP BY rid),
hits AS (SELECT rid, tid, label, n, r, j, i - j AS diagonal FROM p JOIN tg ON w[i] = tw[j] AND w[i + 1] = tw[j + 1] AND w[i + 2] = tw[j + 2]),
starts AS (SELECT DISTINCT rid, tid, diagonal FROM hits),
held AS (SELECT h.rid, tid, label, n, s.diagonal, count(DISTINCT j) AS covered FROM starts s JOIN hits h USING (rid, tid)
  WHERE h.diagonal BETWEEN s.diagonal AND s.diagonal + r GROUP BY ALL),
good AS (SELECT rid, label, covered::DOUBLE / (n - {K - 1}) AS s FROM held WHERE covered >= ceil({COVER}::DOUBLE * (n - {K - 1}))),
every AS (SELECT rid, label, 1.0::DOUBLE AS s FROM places UNION ALL SELECT rid, label, s FROM good),
named AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(s) AS score FROM every GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(b, '') AS base_labels, coalesce(l, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN based USING (rid) LEFT JOIN named USING (rid)
"""


ORACLE_SQL = _oracle()
