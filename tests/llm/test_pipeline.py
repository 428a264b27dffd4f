import corpus_pipeline as c
from tessera.session import table

from tests.llm.test_line_dedup import brute


def test_stages_on_the_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").cache()
    seen = []
    for name, stage in c.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert after.keys() <= before.keys()
        seen.append((name, len(before), len(after)))
        if name == "line_dedup":
            ids = list(before)
            for i, (_, _, text) in zip(ids, brute([before[i].text for i in ids])):
                assert after[i].text == text and after[i].n_chars == len(text)
        if name != "piece_dropout":
            assert tuple(docs.columns) == c.COLUMNS
    assert all(r.lossless for r in after.values())
    by = {name: (a, b) for name, a, b in seen}
    assert by["language_id"][1] >= 0.97 * by["language_id"][0] and by["simhash_near_dedup"][1] < by["simhash_near_dedup"][0]
    whole = {r.doc_id: tuple(r.ids) for r in c.run(spark, sf).collect()}
    assert whole == {i: tuple(r.ids) for i, r in after.items()}


def test_planted_cases(spark, documents):
    import random

    rng = random.Random(1)
    words = [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").where("lang = 'en' AND n_chars > 3000").limit(20).collect()]
    vocabulary = sorted({w for t in words for w in t.split()})
    fresh = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = fresh(300)
    near = base.split()
    near[50], near[200] = "otherword", "anotherword"
    item = table(spark, "/root/testdata/sf0.001", "benchmark").first().text
    texts = [base, base, " ".join(near), fresh(80) + " " + item + " " + fresh(50), None, "12 34", *(fresh(200) for _ in range(14))]
    docs = documents(texts)
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
    assert {r.doc_id for r in docs.collect()} == {0, *range(6, 20)}


def test_texts_of_no_learned_language_go(spark, documents):
    import random

    rng = random.Random(4)
    rows = table(spark, "/root/testdata/sf0.01", "documents").where("n_chars >= 300").orderBy("doc_id").collect()
    known, other = [r for r in rows if r.lang != "de"], [r.text for r in rows if r.lang == "de"]
    cut = lambda t, n: t[(at := rng.randrange(len(t) - n + 1)) : at + n]
    shown, clean = known[:450], [r.text for r in known[450:]]
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    groups = {"clean 40": [cut(t, 40) for t in clean], "clean 300": [cut(t, 300) for t in clean], "other 300": [cut(t, 300) for t in other], "noise 40": [noise(40) for _ in range(150)], "noise 300": [noise(300) for _ in range(150)]}
    texts, langs, names = [r.text for r in shown], [r.lang for r in shown], ["shown"] * len(shown)
    for name, group in groups.items():
        texts += group
        langs += [None] * len(group)
        names += [name] * len(group)
    kept = {r.doc_id for r in c.detect_language(spark, documents(texts, langs=langs), "").collect()}
    share = {g: sum(i in kept for i, name in enumerate(names) if name == g) / names.count(g) for g in groups}
    assert share["clean 40"] >= 0.97 and share["clean 300"] >= 0.97, share
    assert share["other 300"] <= 0.1 and share["noise 40"] <= 0.3 and share["noise 300"] <= 0.1, share  # from 300 learned texts; README has more
