import random
import zlib

import numpy as np
import pytest

from tessera.llm import language_id
from tessera.session import table

SYLLABLES = {"aa": "ba be bi bo bu".split(), "bb": "szt krz prz wcz gdy".split(), "cc": "öä üß äu öh ßt".split()}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"], rng, hidden=3)
    for values in (net.inputs, net.states):
        values[:] = [v.astype(np.float64) for v in values]
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    codes, labels = rng.integers(0, 6, (5, 4)), np.array([0, 1, 2, 1])
    _, gradients = language_id.loss_and_gradients(net, codes, labels)
    for p, g in zip(net.parameters, gradients):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p.shape[-1] == 256:
                at = (at[0], int(rng.integers(0, 6)))
            old, step = p[at], 1e-3
            p[at] = old + step
            up = language_id.loss_and_gradients(net, codes, labels)[0]
            p[at] = old - step
            down = language_id.loss_and_gradients(net, codes, labels)[0]
            p[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-4


def test_windows_equal_a_plain_reading():
    rng = random.Random(2)
    net = language_id.train([(text(rng, x).encode(), x) for x in SYLLABLES for _ in range(5)], rounds=5)
    texts = [text(rng, "aa", n).encode() for n in (1, 30, 200)] + [b"", b"x" * 500]

    def plain(data):
        total = np.zeros(3)
        for at in range(0, len(data), language_id.WINDOW):
            piece = np.frombuffer(data[at : at + language_id.WINDOW].ljust(language_id.WINDOW), np.uint8).astype(np.intp)[:, None]
            states = [language_id._gated(net, piece, way)[0][:, :, 0] for way in range(2)]
            z = np.concatenate(states, axis=1) @ net.out.T + net.bias[:, 0]
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            total += p[: min(language_id.WINDOW, len(data) - at)].sum(axis=0)
        return total / max(1, len(data))

    assert np.allclose(net.document_scores(texts), [plain(t) for t in texts], atol=1e-4)


def test_query_learns_from_the_right_rows_only(documents):
    rng = random.Random(1)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(150)]
    texts = [text(rng, x) for x in langs] + [None, "", " 12 !\n", "ba", "ба", "x" * 200_000]
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    shown = [("zz" if h else x) for h, x in zip(held, [*langs, "aa", "bb", "cc", None, None, None])]
    rows = {r.doc_id: r for r in language_id.query(documents(texts, langs=shown, extra=True)).collect()}
    assert [rows[i].held_out for i in range(len(texts))] == held
    assert "zz" not in {r.lang_pred for r in rows.values()}
    right = [rows[i].lang_pred == langs[i] for i in range(150) if held[i]]
    assert sum(right) >= 0.95 * len(right)
    assert [rows[i].lang_pred for i in (150, 151, 152)] == ["und"] * 3 and rows[150].score == 0
    assert all(rows[i].lang_pred in SYLLABLES for i in (153, 154, 155)) and all(0 <= r.score <= 1 for r in rows.values())


def test_rare_languages_and_whole_texts_are_learned_from(documents):
    texts, langs = ["common words of the text"] * 900 + ["rare ones"] * 9 + ["x" * 9000 + "END" + "y" * 9000], ["aa"] * 900 + ["bb"] * 9 + ["cc"]
    found = language_id.examples(documents(texts, range(0, 4 * len(texts), 4), langs=langs), sample=60)
    by = {x: [t for t, lang in found if lang == x] for x in ("aa", "bb", "cc")}
    shown = [x for i, x in zip(range(0, 4 * len(texts), 4), langs) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(by["bb"]) == shown.count("bb") and len(by["aa"]) == 60 - len(by["bb"]) - shown.count("cc")
    if by["cc"]:
        assert len(by["cc"]) == language_id.PIECES and all(len(t) == language_id.PIECE for t in by["cc"])
        assert {t[:1] for t in by["cc"]} | {t[-1:] for t in by["cc"]} >= {b"x", b"y"}


def test_without_labels_or_rows(documents):
    rows = language_id.query(documents(["abc", None, "abc"], ids=[None, 4, 4], langs=[None, None, None])).collect()
    assert [r.lang_pred for r in rows] == ["und"] * 3 and {r.held_out for r in rows if r.doc_id is None} == {False}
    assert language_id.query(documents(["a"]).limit(0)).count() == 0


def test_held_out_accuracy_on_the_driver_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language_id.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = found.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert right >= 0.97 * n


@pytest.mark.parametrize("value,letters", [(None, False), (b"", False), (b" 1.\n", False), ("é".encode(), True), (b"...Q", True), ("漢".encode(), True), ("´¨".encode(), False)])
def test_letters(value, letters):
    assert language_id.has_letter(value) == letters
