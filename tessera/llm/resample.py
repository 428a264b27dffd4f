"""Quality filtering by importance resampling.

Two generative models of hashed word n-grams (one and two words), one of target text and one of all text,
give each document a weight: how much likelier the target model makes it, as a logarithm. The
documents with the k largest weights after Gumbel noise are kept, which is a sample without replacement in
proportion to the weights. The noise is a keyed hash of the id: equal input gives an equal sample.

Tokens are runs of letters and digits and runs of other characters; A-Z is lower-cased. A word right after
itself is an n-gram named by how often it has stood there (to the next power of two), whatever the word, so that repetition
shows. Both models are of the set of n-grams of a document: an n-gram counts once a document where they are fitted, and where a
document is weighed. So one document's repetitions can't stand for the corpus.

With ``doubt`` 0 the weight is the plain ratio of the two models, with one added to each count. It can't do the work here:
all text is a mixture of kinds of documents, so each common word of the good kind looks a little likelier in the target, and
hundreds of those outweigh a few telling words (the README has figures). Hence the target model has a prior: it
differs from that of all text in few buckets. What is expected in the target is set by the median bucket, and
each logarithm is multiplied by the probability that its bucket differs, given odds of exp(``doubt``) against it and
how many deviations its count is off. That falls smoothly; no bucket is left out.

The target model is fitted on at most ``target_sample`` documents labelled good (quality 1, not toxic); the model
of all text counts all documents. k is the share of good documents among the labelled, of all documents, unless it is
given. The k-th largest key is found exactly, by counting keys by their leading bits in a few rounds.

Defined cases: a null or empty text has weight 0; a null id gets the noise of the text "null"; rows that tie with the
last one kept stay too, so repeated rows stay or go together; with several labels for a document all must be good;
without labelled documents every document has weight 0 and all are kept; an empty table gives an empty result; very long
texts are counted whole; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import ASCII_LOWER, as_bytes, batch
from tessera.llm.sampling import bounded_sample
from tessera.session import small_batches, stored

BITS = 18
TARGET_SAMPLE = 20_000
SEED = 9
DOUBT = 8.0
#: Bytes of text hashed together, but for a single longer text.
_CHUNK = 1 << 21
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_BASE, _INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)
_REPEAT = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hash buckets of n-grams, computed for many texts at once."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            steps = np.ones((2, n), np.uint64)
            steps[0, 1:], steps[1, 1:] = np.uint64(_BASE), np.uint64(_INVERSE)
            self.powers, self.inverses = np.cumprod(steps, axis=1, dtype=np.uint64)

    def sets(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of each text's n-grams, and the text of each; by texts."""
        bucket, owner = self.of(texts)
        once = np.unique(owner << BITS | bucket)
        return once & ((1 << BITS) - 1), once >> BITS

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams, and the text of each."""
        joined = b"\n".join([*((t or b"") for t in texts), b""]).translate(ASCII_LOWER)
        data = np.frombuffer(joined, np.uint8)
        self._grow(len(data) + 1)
        kind = _KIND[data]
        edge = np.flatnonzero(np.diff(kind, prepend=0) != 0)
        start = edge[kind[edge] != 0]
        ends = np.append(edge, len(data))[np.searchsorted(edge, start) + 1]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], dtype=np.uint64, out=total[1:])
        word = (total[ends] - total[start]) * self.inverses[start]
        owner = np.repeat(np.arange(len(texts)), [len(t or b"") + 1 for t in texts])[start] if len(start) else np.zeros(0, np.int64)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        again = word[pair] == word[pair + 1]
        fresh = np.ones(len(pair), bool)  # a run of repeats starts anew here, or there is none
        fresh[1:] = ~again[:-1] | (np.diff(pair) != 1)
        place = np.arange(len(pair))
        run = np.frexp(place - np.maximum.accumulate(np.where(fresh, place, 0)))[1].astype(np.uint64)  # bits of its length
        two = np.where(again, np.uint64(_REPEAT) + run, _mix(word[pair]) * np.uint64(3) + word[pair + 1])
        hashed = np.concatenate([_mix(word), _mix(two ^ np.uint64(0x5851F42D4C957F2D))])
        return (hashed >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([owner, owner[pair]])


def _chunks(texts: list[bytes | None]) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or b"") > _CHUNK:
            yield slice(at, i)
            at, size = i, 0
        size += len(t or b"") + 1
    if at < len(texts):
        yield slice(at, len(texts))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, counts, target = Grams(), np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for rows in batches:
        texts, good = as_bytes(rows["text"]), np.array(rows["good"].to_pylist(), bool)
        for part in _chunks(texts):
            bucket, owner = grams.sets(texts[part])
            counts += np.bincount(bucket, minlength=1 << BITS)
            target += np.bincount(bucket[good[part][owner]], minlength=1 << BITS)
    some = np.flatnonzero(counts)
    yield batch(["bucket", "n", "n_target"], [some.astype(np.int32), counts[some], target[some]])


def good_documents(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labelled documents."""
    rows = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return rows.select("doc_id", F.coalesce((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0), F.lit(False)).alias("good"))


def ratios(docs: DataFrame, target: DataFrame, doubt: float = DOUBT) -> np.ndarray:
    """Per bucket the logarithm of its probability in target text over that in all text. target: a bounded table of ids."""
    marked = docs.select("doc_id", "text").join(F.broadcast(target.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left")
    marked = marked.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = marked.mapInArrow(_counted, "bucket int, n long, n_target long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    rows = found.toArrow()  # at most 2 ** BITS rows
    raw, own = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[rows["bucket"].to_numpy()], own[rows["bucket"].to_numpy()] = rows["n"].to_numpy(), rows["n_target"].to_numpy()
    return log_ratios(raw, own, doubt)


def log_ratios(raw: np.ndarray, own: np.ndarray, doubt: float = DOUBT) -> np.ndarray:
    """Logarithms of target counts over those expected from the counts in all text; with ``doubt``, times the probability that they
    differ at all."""
    if not own.sum():
        return np.zeros(len(raw))
    if not doubt:
        return np.log((own + 1) / (raw * (own.sum() / raw.sum()) + 1))
    share = own / np.maximum(raw, 1)
    order = np.argsort(share, kind="stable")
    mass = np.cumsum(own[order])
    expected = raw * share[order][np.searchsorted(mass, mass[-1] / 2)]
    deviations = (own - expected) ** 2 / (expected + 1)
    return np.log((own + 1) / (expected + 1)) / (1 + np.exp(np.clip(doubt - deviations / 2, -700, 700)))


def gumbel(doc_id: int | None, seed: int) -> float:
    u = (xxhash.xxh64_intdigest(("null" if doc_id is None else str(doc_id)).encode(), seed) >> 11) + 0.5
    return float(-np.log(-np.log(u / 2**53)))


def _weighed(ratio, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table = Grams(), ratio.value
        for rows in batches:
            texts = as_bytes(rows["text"])
            parts = [np.bincount(owner, table[bucket], part.stop - part.start) for part in _chunks(texts) for bucket, owner in [grams.sets(texts[part])]]
            weight = np.concatenate([np.zeros(0), *parts])
            key = weight + np.array([gumbel(d, seed) for d in rows["doc_id"].to_pylist()], np.float64)
            bits = (key + 0.0).view(np.int64)
            yield batch(["doc_id", "log_weight", "key", "place"], [rows["doc_id"], weight, key, bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))])

    return run


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key, place): place is a long in the order of key."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    return docs.select("doc_id", "text").mapInArrow(_weighed(shared, seed), "doc_id long, log_weight double, key double, place long")


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column without nulls; null if there are fewer rows."""
    prefix = None
    for shift in (48, 32, 16, 0):
        part = rows if prefix is None else rows.where(F.shiftright(column, shift + 16) == prefix)
        counts = part.groupBy(F.shiftright(column, shift).alias("p")).count().orderBy(F.col("p").desc()).collect()  # at most 65,536 rows
        for p, n in counts:
            if k <= n:
                prefix = p
                break
            k -= n
        else:
            return None
    return prefix


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, target_sample: int = TARGET_SAMPLE, seed: int = SEED, doubt: float = DOUBT) -> DataFrame:
    """(doc_id, log_weight, key) of the documents kept."""
    small_batches(docs.sparkSession)
    known = good_documents(labels)
    n_good, n_known = known.agg(F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)), F.count("*")).first()
    good = bounded_sample(known.where("good").select("doc_id"), target_sample, n_good, seed, "doc_id")
    rows = stored(weigh(docs, ratios(docs, good, doubt), seed), "weights")
    if k is None:
        n = rows.count()
        k = round(n * n_good / n_known) if n_good else n
    least = kth_largest(rows, "place", k) if k > 0 else None
    kept = rows if least is None and k > 0 else rows.where(F.col("place") >= F.lit(least)) if k > 0 else rows.limit(0)
    return kept.select("doc_id", "log_weight", "key")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return resample(docs, labels)
