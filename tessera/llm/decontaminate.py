"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items are the collection; every passage of the corpus is a query. Items are kept in units of at
most ``UNIT`` words, each with its BM25 weights (a posting list per word), sorted into blocks of ``BLOCK`` units.
Passages are windows of 2 * UNIT words that overlap by half, so whatever a unit and a document share stands
in one window whole.

A unit is retrieved when its score reaches its threshold: the score of the unit's own words, less the
weights of as many of its heaviest words as a copy may lose and still be one. No copy is
missed by it. WAND's bounds are tested for many windows at a time, from the cheapest on: the
sum of each word's greatest weight anywhere against the lowest threshold of all; the sum of its greatest
weight in a block against the block's lowest threshold; and only where a block stays open, the postings of
that block are read and the scores computed. Postings and bounds of a word and a block are one entry, and blocks without the
word have none. There is no limit on what a window retrieves.

Each item retrieved is then verified in the words around the window: of the question's and the answer's runs of
``SHINGLE`` words, at least ``overlap`` must stand there together, and of either at least
``part_overlap``. The question is the item's text up to its first line end, the answer what follows it.

The index is broadcast; if there are more units than ``max_units``, the items are dealt into indexes of
that size and the corpus is read once for each. How rare a word is and how long a unit is on average is taken from all items,
so scores and results are the same whatever the size.

Defined cases: null, empty and blank texts and items match nothing; items and rows that repeat are judged
one by one, and items that tie are all returned; an item shorter than a shingle is one shingle; very long texts are judged
whole; empty tables give an empty result, or let every document stay; other columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import ASCII_LOWER, as_bytes, batch
from tessera.session import small_batches

UNIT = 64
BLOCK = 32
SHINGLE = 5
OVERLAP = 0.8
PART_OVERLAP = 0.5
MAX_UNITS = 20_000
K1, B = 1.2, 0.75
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").translate(ASCII_LOWER))


def shingles(words: list[bytes]) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)

    @classmethod
    def of(cls, item_id: int | None, text: str | None) -> Item:
        first, _, rest = (text or "").partition("\n")
        question, answer = words_of(first.encode()), words_of(rest.encode())
        return cls(item_id, question + answer, shingles(question), shingles(answer))

    def verified(self, words: list[bytes], overlap: float, part_overlap: float) -> tuple[float, float] | None:
        """The overlaps of question and answer (1 for a part that the item lacks), if they suffice."""
        here = shingles(words)
        if len(self.words) < SHINGLE or any(len(s) < SHINGLE for s in (*self.question, *self.answer)):
            for n in {len(s) for s in (*self.question, *self.answer)}:
                here |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        q, a = len(self.question & here), len(self.answer & here)
        total = len(self.question) + len(self.answer)
        q_part, a_part = q / len(self.question) if self.question else 1.0, a / len(self.answer) if self.answer else 1.0
        return (q_part, a_part) if total and q + a >= overlap * total and min(q_part, a_part) >= part_overlap else None


def units_of(words: list[bytes]) -> list[list[bytes]]:
    """An item's words in parts of equal size, of ``UNIT`` words at most."""
    n = -(-len(words) // UNIT)
    cuts = [len(words) * i // n for i in range(n + 1)] if n else []
    return [words[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class Collection:
    """What BM25 knows of all units: how many there are, their mean length, and in how many a word stands."""

    units: int
    mean: float
    df: Counter

    @classmethod
    def of(cls, items: Iterable[Item]) -> Collection:
        units, words, df = 0, 0, Counter()
        for item in items:
            for unit in units_of(item.words):
                units += 1
                words += len(unit)
                df.update(set(unit))
        return cls(units, words / max(1, units), df)

    def weights(self, unit: list[bytes]) -> dict[bytes, float]:
        norm = K1 * (1 - B + B * len(unit) / self.mean)
        return {w: float(np.log(1 + (self.units - self.df[w] + 0.5) / (self.df[w] + 0.5))) * f * (K1 + 1) / (f + norm) for w, f in Counter(unit).items()}


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Index:
    """BM25 weights of units by word, in runs: the postings of a word in a block, with the greatest weight among them."""

    def __init__(self, items: list[Item], overlap: float = OVERLAP, collection: Collection | None = None):
        self.items = [x for x in items if x.words]
        collection = collection or Collection.of(self.items)
        units = [(k, unit) for k, item in enumerate(self.items) for unit in units_of(item.words)]
        weights = [collection.weights(unit) for _, unit in units]
        needed = []
        for (k, unit), own in zip(units, weights):
            lost = int((1 - overlap) * max(1, len(unit) - SHINGLE + 1) + 1e-9) + (2 * SHINGLE if len(self.items[k].words) > UNIT else 0)
            needed.append(sum(sorted(own.values(), reverse=True)[lost:]) * (1 - 1e-9))
        order = sorted(range(len(units)), key=lambda u: needed[u])
        self.unit_item = np.array([units[u][0] for u in order], np.int64)
        self.needed = np.array([needed[u] for u in order])
        self.blocks = -(-len(units) // BLOCK)
        self.block_needed = self.needed[::BLOCK]
        self.term = {w: t for t, w in enumerate(sorted(set().union(*weights)))} if weights else {}
        size = np.array([len(weights[u]) for u in order], np.int64)
        term = np.array([self.term[w] for u in order for w in weights[u]], np.int64)
        weight = np.array([x for u in order for x in weights[u].values()])
        place = np.repeat(np.arange(len(order)), size)
        by_term = np.argsort(term, kind="stable")
        term, self.places, self.weights = term[by_term], place[by_term], weight[by_term]
        block = self.places // BLOCK
        first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
        self.run_block, self.run_start, self.run_size = block[first], first, np.diff(np.append(first, len(term)))
        self.run_most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_start = np.searchsorted(term[first], np.arange(len(self.term) + 1))
        self.most = np.zeros(len(self.term) + 1)  # the last is for words of no item
        np.maximum.at(self.most, term, self.weights)

    def retrieve(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """windows: rows of term numbers, the number of terms for other words. All (window, unit, score) at or
        above the unit's threshold; a word counts once a window."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if not self.blocks or not len(windows):
            return none
        blank = len(self.term)
        ordered = np.sort(windows, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = blank
        alive = np.flatnonzero(self.most[ordered].sum(axis=1) >= self.needed[0])
        step, found = max(1, min(4096, (1 << 22) // self.blocks)), []
        for at in range(0, len(alive), step):
            rows = alive[at : at + step]
            owner, place = np.nonzero(ordered[rows] != blank)
            terms = ordered[rows][owner, place]
            n = self.term_start[terms + 1] - self.term_start[terms]
            run, who = _spans(self.term_start[terms], n), np.repeat(owner, n)
            cell = who * self.blocks + self.run_block[run]
            bound = np.bincount(cell, self.run_most[run], len(rows) * self.blocks).reshape(len(rows), self.blocks)
            inside = (bound >= self.block_needed * (1 - 1e-9)).ravel()[cell]
            run, who = run[inside], who[inside]
            entry, who = _spans(self.run_start[run], self.run_size[run]), np.repeat(who, self.run_size[run])
            pairs, back = np.unique(who * len(self.needed) + self.places[entry], return_inverse=True)
            score = np.bincount(back, self.weights[entry], len(pairs))
            who, unit = pairs // len(self.needed), pairs % len(self.needed)
            enough = score >= self.needed[unit]
            found.append((rows[who[enough]], unit[enough], score[enough]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else none

    def search(self, texts: list[bytes | None], overlap: float = OVERLAP, part_overlap: float = PART_OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """(text number, item number, score, question overlap, answer overlap) of what is verified, one per text and item."""
        blank, get = len(self.term), self.term.get
        words = [words_of(t) for t in texts]
        blocks, owners, offsets = [], [], []
        for d, own in enumerate(words):
            if own:
                ids = np.full((max(1, -(-len(own) // UNIT) - 1) + 1) * UNIT, blank, np.int32)
                ids[: len(own)] = [get(w, blank) for w in own]
                windows = np.lib.stride_tricks.sliding_window_view(ids, 2 * UNIT)[::UNIT]
                blocks.append(windows)
                owners.append(np.full(len(windows), d))
                offsets.append(np.arange(len(windows)) * UNIT)
        if not blocks:
            return []
        owner, offset = np.concatenate(owners), np.concatenate(offsets)
        window, unit, score = self.retrieve(np.concatenate(blocks))
        best: dict[tuple[int, int], tuple] = {}
        for w, k, x in sorted(zip(window.tolist(), self.unit_item[unit].tolist(), score.tolist())):
            d, item = int(owner[w]), self.items[k]
            reach = max(0, len(item.words) - UNIT)
            here = words[d][max(0, int(offset[w]) - reach) : int(offset[w]) + 2 * UNIT + reach]
            parts = item.verified(here, overlap, part_overlap)
            if parts:
                best[d, k] = max(best.get((d, k), (0.0, 0.0, 0.0)), (x, *parts))
        return [(d, k, *v) for (d, k), v in best.items()]


def _items(bench: DataFrame) -> Iterator[Item]:
    for row in bench.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        yield Item.of(row["item_id"], row["text"])


def indexes(bench: DataFrame, overlap: float = OVERLAP, max_units: int = MAX_UNITS) -> Iterator[Index]:
    """Indexes over all items, each of at most about ``max_units`` units. The items pass through the driver twice, an index at a time."""
    collection = Collection.of(_items(bench))
    part, units = [], 0
    for item in _items(bench):
        part.append(item)
        units += -(-len(item.words) // UNIT)
        if units >= max_units:
            yield Index(part, overlap, collection)
            part, units = [], 0
    if part:
        yield Index(part, overlap, collection)


def _found(index, overlap: float, part_overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hits = index.value.search(as_bytes(rows["text"]), overlap, part_overlap)
            ids = rows["doc_id"].to_pylist()
            columns = list(zip(*((ids[d], index.value.items[k].item_id, *rest) for d, k, *rest in hits))) or [()] * 5
            yield batch(_NAMES, [pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(columns)])

    return run


def leaks(docs: DataFrame, bench: DataFrame, overlap: float = OVERLAP, part_overlap: float = PART_OVERLAP, max_units: int = MAX_UNITS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): every item that stands in a document."""
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for index in indexes(bench, overlap, max_units):
        run = _found(spark.sparkContext.broadcast(index), overlap, part_overlap)
        part = docs.select("doc_id", "text").mapInArrow(run, _FOUND)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], _FOUND) if out is None else out


def _kept(index, overlap: float, part_overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hit = {d for d, *_ in index.value.search(as_bytes(rows["text"]), overlap, part_overlap)}
            yield rows.filter(pa.array([d not in hit for d in range(rows.num_rows)], pa.bool_()))

    return run


def clean(docs: DataFrame, bench: DataFrame, overlap: float = OVERLAP, part_overlap: float = PART_OVERLAP, max_units: int = MAX_UNITS) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in indexes(bench, overlap, max_units):
        docs = docs.mapInArrow(_kept(spark.sparkContext.broadcast(index), overlap, part_overlap), docs.schema)
    return docs


def query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return leaks(docs, bench).select(*_NAMES[:2], F.col("score"), *_NAMES[3:])
