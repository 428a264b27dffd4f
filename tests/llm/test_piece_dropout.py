import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from tessera.llm import piece_dropout as p
from tessera.session import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a  b\n c", "", None, "  x ", " ", "▁a b▁▁ c", "é\tz", "Hello world.\nHi there internationalization", "x" * 300 + " yyyy", "日本語 テキスト 🙂", "\n\n a\n", "tokenization of merging pieces " * 5, "\x00\x01", "a" * 60_000]


def ids_of(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_without_dropout_it_is_the_library(spark):
    library, coder = sentencepiece.SentencePieceProcessor(model_file=MODEL), p.Dropout(p.Pieces(MODEL), rate=0)
    texts = [t for t in TEXTS if t is not None and "▁" not in t and len(t) < 1000]
    texts += [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    for text, raw in zip(texts, coder.encode(texts, [None] * len(texts))):
        assert ids_of(raw) == library.encode(text)


def test_every_segmentation_is_lossless_and_valid():
    pieces = p.Pieces(MODEL)
    for rate in (0.0, 0.1, 0.5, 1.0):
        coder = p.Dropout(pieces, rate=rate)
        for doc in range(4):
            for text, raw in zip(TEXTS, coder.encode(TEXTS, [doc] * len(TEXTS))):
                assert pieces.decode(ids_of(raw)) == (text or "")


def test_matrix_steps_equal_the_agenda():
    pieces = p.Pieces(MODEL)
    words = [" internationalization", " merge", "aaaa", " zzzéé", "日本語", " a", "b", "▁x▁", " ththeonering"]
    for rate in (0.1, 0.4):
        coder = p.Dropout(pieces, rate=rate)
        for variant in range(4):
            for w in words:
                assert ids_of(coder.many([w, w], variant)[1]) == coder.one(w, variant)


def test_seeds_variants_and_memory(monkeypatch):
    pieces, text = p.Pieces(MODEL), "segmentations of internationalization vary between documents " * 8
    first = {tuple(ids_of(p.Dropout(pieces).encode([text], [d])[0])) for d in range(20)}
    assert 1 < len(first) <= p.VARIANTS
    other = {tuple(ids_of(p.Dropout(pieces, seed=21).encode([text], [d])[0])) for d in range(20)}
    assert not first & other
    whole = p.Dropout(pieces).encode(TEXTS, range(len(TEXTS)))
    monkeypatch.setattr(p, "MEMORY", 3)
    forgetful = p.Dropout(pieces)
    assert [forgetful.encode([t], [i])[0] for i, t in enumerate(TEXTS)] == whole


def test_query(documents):
    ids = list(range(len(TEXTS)))
    ids[3], ids[5] = None, 4
    rows = p.query(documents(TEXTS, ids, extra=True)).collect()
    coder = p.Dropout(p.Pieces(MODEL))
    want = [(d, len(raw) // 4, zlib.crc32(raw), True) for d, raw in zip(ids, coder.encode(TEXTS, ids))]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert p.query(documents(["a"]).limit(0)).count() == 0


def test_decode_reads_what_encode_writes(documents):
    docs = documents(TEXTS, extra=True)
    rows = p.decode(p.encode(docs, MODEL, rate=0.5), MODEL).collect()
    assert len(rows) == len(TEXTS) and all(r.decoded == (r.text or "") and r.lossless and len(r.ids) == r.n_pieces and r.host == "host" for r in rows)


def test_every_occurrence_is_cut_on_its_own():
    pieces, n = p.Pieces(MODEL), 4000
    coder = p.Dropout(pieces)

    def cuts(word):
        out = []
        for i in ids_of(coder.encode([(word * n)[1:]], [7])[0]):
            if pieces.text[i].startswith(b" "):
                out.append(())
            out[-1] += (i,)
        return out

    assert len(cuts(" merge")) == n and len(set(cuts(" merge"))) > 4
    merged = sum(len(c) == 1 for c in cuts(" a"))  # the one candidate is skipped at the rate
    assert abs(merged - 0.9 * n) < 5 * (0.09 * n) ** 0.5
    # the same of documents of one word each, and of a word too long for the matrix
    assert len({raw for raw in coder.encode(["merge"] * 400, range(400))}) > 4
    assert len({raw for raw in coder.encode(["internationalization" * 3] * 40, range(40))}) > 30
