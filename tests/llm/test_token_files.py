import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello world. It's ok, A.B.C ... x, y", "<|startoftext|> a <|STARTOFTEXT|>B.", "ÀÉ'S Ὀδυσσεύς ΑΣ.", "é.  ́ a\tb\r\nc\x1cd\x85e f", "日本語、テスト.",
    "a,b a, b.c. end.", "it's. they'll, can't.\nNO.\n", "", None, "x" * 30_000, "Straße Éß. ÿ, À÷É. ñ.,", "   ", "same", "same",
]


def library_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def encoded(encoder, texts, *end):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()), *end)
    ends = np.cumsum(sizes)
    return [ids[a:b].tolist() for a, b in zip(ends - sizes, ends)]


def test_words_give_the_library_ids():
    encoder = token_files.WordEncoder(PATH)
    for texts in (TEXTS, list(reversed(TEXTS))):
        assert encoded(encoder, texts) == [library_ids(t) for t in texts]
        assert encoded(encoder, texts, 7, 2) == [[*library_ids(t), 7, 2] for t in texts]
    assert encoded(encoder, []) == []
    assert encoder.encode(pa.array(TEXTS, pa.string()).slice(3, 4))[1].tolist() == [len(library_ids(t)) for t in TEXTS[3:7]]


def test_random_texts_give_the_library_ids():
    rng, encoder, library = random.Random(2), token_files.WordEncoder(PATH), Tokenizer.from_file(PATH)
    signs = ["a", "B", "é", "É", "ß", "İ", "\u0301", ".", ",", "'s", "'", "1", " ", "  ", "\n", "\t", "\r", "\x85", "\u00a0", "\u3000", "語", "<|endoftext|>", "&&", "-", "<", "|", "]", "\\", "_", "der", "Ñandú", "\u212a", "😀"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(12))) for _ in range(3000)]
    for at in range(0, 3000, 500):
        part = texts[at : at + 500]
        assert encoded(encoder, part) == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("bound", ["MEMORY", "MEMORY_BYTES"])
def test_forgetting_changes_nothing(monkeypatch, bound):
    monkeypatch.setattr(token_files, bound, {"MEMORY": 5, "MEMORY_BYTES": 400}[bound])
    encoder = token_files.WordEncoder(PATH)
    for _ in range(3):
        for text in TEXTS:
            assert encoded(encoder, [text]) == [library_ids(text)]


def test_query_reads_back_what_the_library_gives(documents):
    ids = [13, 5, 2, 90, 41, 7, 3, 1, 66, 30, 8, None, 12, 12]
    rows = {(r.doc_id, r.start): r for r in token_files.query(documents(TEXTS, ids, extra=True)).collect()}
    order = sorted(zip(ids, TEXTS), key=lambda x: -1 if x[0] is None else x[0])
    start = 0
    for doc, text in order:
        want = [*library_ids(text), 2]
        row = rows[doc, start]
        assert (row.n_tokens, row.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_have_the_encodings_and_indexes(documents, spark, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_files.write_tokens(documents(TEXTS[:8] * 40, range(320)), path, PATH, encoding=encoding, parts=2)
    assert token_files.read_metadata(spark, path).agg({"n_tokens": "sum"}).first()[0] == 40 * sum(len(library_ids(t)) + 1 for t in TEXTS[:8])
    assert [r.tokens for r in token_files.read_tokens(spark, path, [17]).collect()] == [[*library_ids(TEXTS[1]), 2]]
    seen = set()
    for file in (tmp_path / encoding).glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        for i in range(group.num_columns):
            column = group.column(i)
            if column.path_in_schema.startswith("tokens"):
                seen |= set(column.encodings)
            assert column.has_offset_index
    assert ("RLE_DICTIONARY" in seen) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in seen) == (encoding == "delta")
    with pytest.raises(ValueError):
        token_files.write_tokens(documents(["a"]), path, PATH, encoding="plain")


def test_empty_table(spark):
    assert token_files.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
