"""Token ids in Parquet files: encode, write in document order, read back selectively.

A folder of token files has one file per range of document ids, in ascending order. Each row is a document:

    doc_id    as in the input; delta encoded
    part      number of the range, from 0
    part_start  ids of all documents before it in its range; delta encoded
    n_tokens  ids of the document, the end id included; delta encoded
    tokens    the ids, a list column of 32-bit integers; dictionary or delta encoded

Row groups and pages have set sizes, and every file has a page index, so that readers of a few documents
read a few pages, and readers of the metadata no tokens at all. ``start``, the ids of all documents
before one, is its range's offset (a sum over the ranges before it) plus ``part_start``.

The files are written by Spark's own committed writer: a task that is lost is run again and its files
replace nothing. Ids and their order are a function of the rows alone, so a second run gives the same.

Defined cases: a null text is like an empty one, just the end id; documents without an id come first;
rows that repeat an id (ties) are ordered by a hash of their text and may lie in several files, rows that
repeat that too are alike in all that is stored; very long texts are encoded whole; an empty table gives no rows; other
columns aren't stored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.arrow import batch
from tessera.session import scratch_path, small_batches

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 512
#: Bytes of text that a file holds, about, where there are more than the session's shuffle partitions make.
FILE_BYTES = 1 << 30
#: Words whose ids a worker remembers, and their bytes; when there are more, those met in one batch only since the last time are forgotten.
MEMORY, MEMORY_BYTES = 300_000, 64 << 20
#: Lower-case letters of these blocks have one form only, and are letters to the tokenizer's patterns; signs after them are a
#: piece of their own (but for the apostrophe, and those that special tokens are written with).
_LETTERS = "".join(chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))
_SIGNS = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
_PLAIN = f"^[{_LETTERS}]+[{re.escape(_SIGNS)}]*$"
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
_COLUMNS = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Memory:
    """The ids of words, as slots of one flat array."""

    def __init__(self):
        self.words = pa.array([], pa.string())
        self.start = self.size = self.met = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def find(self, words: pa.Array, learn: Callable[[np.ndarray], list[list[int]]]) -> np.ndarray:
        """The slots of distinct words; ``learn`` gives the ids of those not known, by their ascending places in ``words``."""
        found = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            lists = learn(new)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            first = len(self.size)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size, self.met = np.concatenate([self.size, size]), np.concatenate([self.met, np.zeros(len(size), np.int64)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))])
            found[new] = np.arange(first, first + len(size))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new))])
        self.met[found] += 1
        return found

    def full(self) -> bool:
        return len(self.words) > MEMORY or self.words.nbytes > MEMORY_BYTES

    def forget(self) -> None:
        """Only words met twice or more since the last time stay, if they are few enough."""
        keep = np.flatnonzero(self.met > 1)
        words = self.words.take(pa.array(keep))
        if len(keep) > MEMORY // 2 or words.nbytes > MEMORY_BYTES // 2:
            keep, words = keep[:0], words[:0]
        self.words, self.ids, self.size = words, self.ids[spans(self.start[keep], self.size[keep])], self.size[keep]
        self.start, self.met = np.cumsum(self.size) - self.size, np.zeros(len(keep), np.int64)


class WordEncoder:
    """Whole texts through a byte-level BPE tokenizer that lower-cases and never looks across a blank. A batch's texts are cut
    into words, and only its distinct words are looked up; words met lately aren't encoded again.

    Words of Latin letters are one piece for the tokenizer's model, and go to it directly; so are signs after them. It is the
    rest that needs the tokenizer's own normalizer and patterns.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memory = Memory()

    def _letters(self, words: list[str]) -> list[list[int]]:
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LEVEL))] for w in words]

    def _others(self, words: list[str]) -> list[list[int]]:
        parts = [self.tokenizer.encode_batch_fast(words[at : at + 10_000], add_special_tokens=False) for at in range(0, len(words), 10_000)]
        return [found.ids for part in parts for found in part]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and how many each has."""
        memory = self.memory
        if memory.full():
            memory.forget()
        plain = pc.match_substring_regex(words, _PLAIN)
        known, rest = words.filter(plain), words.filter(pc.invert(plain))
        letters, signs = (x.dictionary_encode() for x in (pc.utf8_lower(pc.utf8_rtrim(known, _SIGNS)), pc.utf8_ltrim(known, _LETTERS)))
        n, m = len(letters.dictionary), len(signs.dictionary)
        pieces = pa.concat_arrays([letters.dictionary, signs.dictionary, rest]).dictionary_encode()

        def learn(new: np.ndarray) -> list[list[int]]:
            names = pieces.dictionary.take(pa.array(new)).to_pylist()
            at = int(np.searchsorted(new, n))  # the first n are words of letters
            return self._letters(names[:at]) + self._others(names[at:])

        found = memory.find(pieces.dictionary, learn)[pieces.indices.to_numpy()]
        first, second, rest = found[:n][letters.indices.to_numpy()], found[n : n + m][signs.indices.to_numpy()], found[n + m :]
        plain = plain.to_numpy(zero_copy_only=False)
        slots = np.full((len(words), 2), -1)
        slots[plain, 0], slots[plain, 1], slots[~plain, 0] = first, second, rest
        slots = slots.ravel()
        start, size = memory.start[slots], np.where(slots < 0, 0, memory.size[slots])
        return memory.ids[spans(start, size)], size.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array, *end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the ids ``end`` after it, and how many each text has."""
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        ids, size = self._words(words.dictionary)
        index = words.indices.to_numpy()
        n = size[index]
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        bounds = cut.offsets.to_numpy()
        count = np.diff(after[bounds - bounds[0]])
        out = np.empty(int(count.sum()) + len(end) * len(texts), np.int32)
        place = np.ones(len(out), bool)
        last = np.cumsum(count + len(end))
        for k, x in enumerate(reversed(end)):
            out[last - 1 - k], place[last - 1 - k] = x, False
        out[place] = ids[spans((np.cumsum(size) - size)[index], n)]
        return out, count + len(end)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker; what it remembers changes its speed, not its ids."""
    return WordEncoder(path)


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(path), TaskContext.get().partitionId(), 0
        for rows in batches:
            ids, n = encoder.encode(rows["text"], end_id)
            after = np.cumsum(n)
            before = after - n + start
            start += len(ids)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], after]).astype(np.int32)), pa.array(ids))
            yield batch(["doc_id", "part", "part_start", "n_tokens", "tokens"], [rows["doc_id"], np.full(len(n), part, np.int32), before, n, tokens])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encoding: str = "dictionary", parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write token files to the folder ``path``.

    tokenizer: a file of the tokenizers library whose pre-tokenizer splits at white space.
    encoding: "dictionary" or "delta", that of the ids.
    parts: files; unless given as many as the bytes of the texts ask for.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    spark = docs.sparkSession
    small_batches(spark)
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = ordered.select("doc_id", "text").mapInArrow(_encoded(tokenizer, end_id), _COLUMNS)
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": 1 << 20,
    }
    rows.write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading a token."""
    return with_start(spark.read.parquet(path)).select("doc_id", "start", "n_tokens")


def with_start(rows: DataFrame) -> DataFrame:
    """Adds ``start``. The offsets have one row per file, whatever the number of documents."""
    spark = rows.sparkSession
    sizes = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    table = F.broadcast(spark.createDataFrame(offsets, "part int, offset long"))
    return rows.join(table, "part").withColumn("start", F.col("offset") + F.col("part_start")).drop("offset")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, tokens), of some documents only if asked: pages without them are skipped."""
    rows = spark.read.parquet(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.select("doc_id", "tokens")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        lists = rows["tokens"]
        values, ends = np.ascontiguousarray(lists.values.to_numpy(), "<i4").view(np.uint8), lists.offsets.to_numpy()
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield batch(["doc_id", "start", "n_tokens", "ids_crc32"], [rows["doc_id"], rows["start"], rows["n_tokens"], pa.array(sums, pa.int64())])


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    rows = with_start(spark.read.parquet(path))
    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
