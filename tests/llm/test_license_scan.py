import random
import re

from tessera.llm import license_scan

PHRASES = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
TEXTS = [
    "Released UNDER the MIT License. under-the_mit  license", "Licensed under the Apache License, Version 2.0.", "CC-BY/NC and cc by nc 4.0 cc by nc", "", None, "cc by", "under the mit",
    "under the mit license" + " word" * 20_000 + " under the mit license", "ünder the mit license", "\u212aiosk under the mit license \u0130t", "x cc by\nnc y", "This work is licensed under the GNU General Public License, version 3.",
    "this work is now licensed under the gnu general public license version 3", "the gnu general license is public", "cc by nc by nc", "under the mit license", "under the mit license",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    found = [(i, label) for label, p in PHRASES.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_columns_equal_brute_force(documents):
    ids = [*range(len(TEXTS))]
    ids[3], ids[8] = None, 7
    rows = license_scan.query(documents(TEXTS, ids, extra=True)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in zip(ids, TEXTS)), key=repr)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert all(r.labels == ",".join(sorted(set(r.labels.split(",")))) for r in rows)


def test_the_method_finds_notices_with_words_put_in(documents):
    by = {r.doc_id: r for r in license_scan.query(documents(TEXTS)).collect()}
    assert by[11].labels == "gpl-3" and by[11].score == 1
    assert by[12].labels == "gpl-3" and 0.75 <= by[12].score < 1
    assert by[13].labels == "" and by[13].score == 0


def found(text, template):
    """The most runs of three words of the template that stand on one diagonal or the next ones in its reach."""
    w, t = words(text), template.split()
    places = [(i - j, j) for i in range(len(w) - 2) for j in range(len(t) - 2) if w[i : i + 3] == t[j : j + 3]]
    most = max((len({j for e, j in places if d <= e <= d + license_scan.reach(len(t))}) for d, _ in places), default=0)
    return most / (len(t) - 2)


def test_labels_equal_brute_force_whatever_stands_around_a_notice(documents):
    rng = random.Random(4)
    texts, sure = [], []
    for label, template in license_scan.TEMPLATES:
        own = template.split()
        halves = [" ".join(own[: len(own) // 2]), " ".join(own[len(own) // 2 :]), " ".join(own[:3])]
        for text in (f"{halves[2]} " * 6 + template, template + f" {halves[1]}" * 9, f"{halves[0]} {template} {halves[0]}", " ".join([template] * 30), f"{halves[2]} {halves[2]} x " * 40 + template + f" y {halves[1]}" * 40):
            texts.append(text)
            sure.append(label)
        other = rng.choice(license_scan.TEMPLATES)[1].split()
        texts += [" ".join(x for pair in zip(own, other) for x in pair), " ".join([*own[:4], "word", *own[4:]]), " ".join([*own[:5], *own[7:]]), " ".join(rng.choices(own, k=200))]
        sure += [None] * 4
    rows = {r.doc_id: r for r in license_scan.query(documents(texts)).collect()}
    for i, (text, label) in enumerate(zip(texts, sure)):
        scores = [(found(text, t), name) for name, t in license_scan.TEMPLATES]
        named = {name for s, name in scores if s >= license_scan.COVER} | set(brute(text)[4].split(",")) - {""}
        assert rows[i].labels == ",".join(sorted(named)), text
        assert label is None or (label in rows[i].labels.split(",") and rows[i].score == 1), text


def test_spans_are_the_best_of_those_that_overlap(documents):
    template = dict((name, t) for name, t in license_scan.TEMPLATES)["bsd"]
    text = "redistribution and use " * 3 + template + " and so on " + template
    spans = [s for s in license_scan.scan(documents([text])).first().spans if s.label == "bsd"]
    n = len(template.split())
    assert [(s.first, s.last, s.score) for s in spans] == [(9, 8 + n, 1.0), (12 + n, 11 + 2 * n, 1.0)]


def test_plan_has_no_python(documents):
    plan = license_scan.query(documents(TEXTS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan) and "BroadcastHashJoin" in plan


def test_empty_table(spark):
    assert license_scan.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
