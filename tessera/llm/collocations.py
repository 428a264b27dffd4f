"""Phrases that stand together more often than their parts suggest.

Texts are cut into shards of a bounded size, each of one language. A shard's words get numbers, and its suffix array, to
the depth of the longest phrase, is built by prefix doubling: ranks of one word give ranks of two, those of four. Neighbouring
suffixes that agree on their first L words are an interval of the array, and the interval's size is the count of its phrase. The
counts are merged over all shards by language and phrase.

Three passes keep what is shuffled small, without leaving out anything that counts: words first; then pairs of words that are both
frequent enough; then longer phrases all of whose pairs are. A phrase can't be more frequent than what it holds. What is
frequent goes to the tasks as a bitmap of hashes of a fixed size (2 ** ``BITS`` bits); a hash that others share lets a rare
word or pair through, whose phrases the merged counts then reject. So every count of a phrase that is found is exact.

A phrase is judged by the cut that explains it best, and left out if a longer one stands wherever it does. Parts and longer phrases
are found by joins by key; those of a part that very many phrases have by broadcast (``join_spread``). The best of a language are
taken from the best of its shares, so no task sees all phrases of a language.

Defined cases: a null text is empty; a null language is ``und``, together with what is named so; repeated rows count each; a text
longer than a shard is cut between words, and the words after the cut are read along, so nothing is lost there; an empty table gives
an empty result; ties go by phrase in byte order; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import as_bytes, batch
from tessera.llm.components import join_spread
from tessera.session import small_batches, stored

LONGEST, LEAST, TOP = 5, 100, 2000
BITS = 27
#: Bytes of text in a shard, but for a single longer word.
SHARD = 4 << 20
#: Shares of a language that are ranked apart first.
SHARES = 64
_END = ord(".")
#: Lower-cases A-Z, and gives every character that ends a piece the same one.
_PLAIN = bytes(_END if i in b".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))
_COUNTS = "lang string, words int, phrase binary, n long"


# --- shards --------------------------------------------------------------------------------------


def _ahead(text: bytes, at: int, n: int) -> bytes:
    """The next ``n`` words of the piece that goes on at a place of a text."""
    size = 1 << 12
    while True:
        part = text[at : at + size].translate(_PLAIN)
        piece, end, _ = part.partition(b".")
        words = piece.split()
        if end or at + size >= len(text) or len(words) > n:
            return b" ".join(words[:n])
        size *= 4


def cuts(text: bytes, size: int = SHARD, ahead: int = LONGEST - 1) -> Iterator[tuple[bytes, bytes]]:
    """(part, words read along) of a text, plain; parts are cut between pieces where they can be, else between words."""
    at = 0
    while len(text) - at > size:
        step = size
        while True:
            part = text[at : at + step].translate(_PLAIN)
            end, blank = part.rfind(b".") + 1, max(part.rfind(b" "), part.rfind(b"\t"))
            if end or blank > 0 or at + step >= len(text):
                break
            step *= 2
        if end or blank <= 0:
            part = part[: end or len(part)]
            yield part, b""
        else:
            part = part[:blank]
            yield part, _ahead(text, at + blank, ahead)
        at += len(part)
    yield text[at:].translate(_PLAIN), b""


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[bytes, bytes]]]]:
    """(language, parts) of about ``SHARD`` bytes at most."""
    held: dict[str, list] = {}
    size = 0
    for rows in batches:
        for lang, text in zip(rows["lang"].to_pylist(), as_bytes(rows["text"])):
            for part in cuts(text or b""):
                if size + len(part[0]) > SHARD and size:
                    yield from held.items()
                    held, size = {}, 0
                held.setdefault(lang, []).append(part)
                size += len(part[0])
    yield from held.items()


class Shard:
    """Numbered words of one language; 0 stands between pieces. ``own``: the words that phrases may start with here."""

    def __init__(self, lang: str, parts: list[tuple[bytes, bytes]]):
        joined = b"".join(a + b" " + b + b"." for a, b in parts).replace(b".", b" . ")
        whole = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(joined)], np.int32)), pa.py_buffer(joined))
        words = pc.ascii_split_whitespace(whole).flatten().cast(pa.binary())
        words = words.filter(pc.not_equal(words, b"")).dictionary_encode()
        self.lang, self.names = lang, words.dictionary
        number = words.indices.to_numpy().astype(np.int64) + 1
        end = pc.index(self.names, b".").as_py() + 1
        self.words, self.own = np.where(number == end, 0, number), np.ones(len(number), bool)
        if any(b for _, b in parts):
            self._read_along(parts)

    def _read_along(self, parts: list[tuple[bytes, bytes]]) -> None:
        """The same word by word, for the few shards with parts of long texts."""
        index = {w: i + 1 for i, w in enumerate(self.names.to_pylist())}
        words, own = [], []
        for a, b in parts:
            for part, here in ((a, True), (b, False)):
                found = [0 if w == b"." else index[w] for w in part.replace(b".", b" . ").split()]
                words += found
                own += [here] * len(found)
            words.append(0)
            own.append(True)
        self.words, self.own = np.array(words, np.int64), np.array(own, bool)

    def hashes(self) -> np.ndarray:
        head = self.lang.encode() + b"\0"
        return np.array([0, *(xxhash.xxh3_64_intdigest(head + w) for w in self.names.to_pylist())], np.uint64)

    def split_where(self, broken: np.ndarray) -> None:
        """Ends pieces after the words where ``broken``, and drops what has no neighbour left."""
        link = np.append(~broken[:-1] & (self.words[:-1] > 0) & (self.words[1:] > 0), False)
        kept = link | np.append(False, link[:-1])
        slots = np.where(kept, 1 + ~link, 0)
        at = np.cumsum(slots) - slots
        words, own = np.zeros(int(slots.sum()), np.int64), np.zeros(int(slots.sum()), bool)
        words[at[kept]], own[at[kept]] = self.words[kept], self.own[kept]
        self.words, self.own = words, own

    def phrases(self, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first word of an occurrence, count) of the phrases of least to most words, by intervals of the suffix array."""
        n = len(self.words)
        padded = np.append(self.words, np.zeros(2 * most, np.int64))
        rank, width = {1: padded}, 1
        while 2 * width <= most:
            low = rank[width]
            high = np.append(low[width:], np.zeros(width, np.int64))
            _, found = np.unique(low * (low.max() + 1) + high, return_inverse=True)
            rank[2 * width], width = found.astype(np.int64), 2 * width
        starts = np.flatnonzero(self.own & (self.words > 0) & (padded[1 : n + 1] > 0))
        first, rest = rank[width][starts], [padded[starts + k] for k in range(width, most)]
        order = starts[np.lexsort([*rest[::-1], first])] if rest else starts[np.argsort(first, kind="stable")]
        if not len(order):
            return
        for length in range(least, most + 1):
            new, at = np.zeros(len(order), bool), 0
            for w in sorted(rank, reverse=True):  # a length is a sum of powers of two
                while at + w <= length:
                    own = rank[w][order + at]
                    new[1:] |= own[1:] != own[:-1]
                    at += w
            new[0] = True
            begins = np.flatnonzero(new)
            counts = np.diff(np.append(begins, len(order)))
            whole = np.all([padded[order[begins] + k] > 0 for k in range(length)], axis=0)
            yield length, order[begins][whole], counts[whole]

    def rows(self, length: int, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        words = [self.names.take(pa.array(self.words[at + k] - 1)) for k in range(length)]
        phrase = words[0] if length == 1 else pc.binary_join_element_wise(*words, b" ")
        return batch(["lang", "words", "phrase", "n"], [pa.repeat(pa.scalar(self.lang), len(at)), np.full(len(at), length, np.int32), phrase, counts.astype(np.int64)])


# --- what is frequent ------------------------------------------------------------------------------


def _fold(hashed: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (hashed * np.uint64(0x9E3779B97F4A7C15)) ^ word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of one or two words -> the words of the bitmap that they set."""
    for rows in batches:
        seen = np.zeros(rows.num_rows, np.uint64)
        for i, (lang, phrase) in enumerate(zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist())):
            words = [xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + w) for w in phrase.split(b" ")]
            seen[i] = words[0] if len(words) == 1 else _fold(np.array(words[:1], np.uint64), np.array(words[1:], np.uint64))[0]
        bit = (seen >> np.uint64(64 - BITS)).astype(np.int64)
        place, inverse = np.unique(bit >> 6, return_inverse=True)
        bits = np.zeros(len(place), np.uint64)
        np.bitwise_or.at(bits, inverse, np.uint64(1) << (bit & 63).astype(np.uint64))
        yield batch(["place", "bits"], [place, bits.view(np.int64)])


def bitmap(frequent: DataFrame) -> np.ndarray:
    """The hashes of a table of phrases, as a bitmap of a fixed size."""
    found = frequent.select("lang", "phrase").mapInArrow(_marked, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2 ** (BITS - 6) rows at most
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def _held(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    bit = hashed >> np.uint64(64 - BITS)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


# --- counts -----------------------------------------------------------------------------------------


def merged(texts: DataFrame, count, least: int, totals: bool = False) -> DataFrame:
    """The rows of all shards, added up, with those of ``least`` and more; a row without a phrase has a language's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, parts in shards(batches):
            shard = Shard(lang, parts)
            if totals:
                n = int(((shard.words > 0) & shard.own).sum())
                yield batch(["lang", "words", "phrase", "n"], [[lang], pa.array([0], pa.int32()), pa.array([None], pa.binary()), [n]])
            if len(shard.words):
                yield from (shard.rows(*found) for found in count(shard))

    counted = texts.mapInArrow(run, _COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return stored(counted.where((F.col("n") >= least) | F.col("phrase").isNull()), "counts")


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, n): all phrases of up to ``longest`` words found ``least`` times or more; without a phrase, a language's words."""
    if longest > LONGEST or longest < 2:
        raise ValueError("phrases have 2 to 5 words")
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    send = docs.sparkSession.sparkContext.broadcast

    def single(shard: Shard):
        n = np.bincount(shard.words[shard.own], minlength=1)
        n[0] = 0
        some = np.flatnonzero(n)
        at = np.zeros(len(n), np.int64)
        at[shard.words] = np.arange(len(shard.words))
        yield 1, at[some], n[some]

    words = merged(texts, single, least, totals=True)
    frequent_words = send(bitmap(words.where("words = 1")))

    def rare(shard: Shard) -> np.ndarray:
        """Words that aren't frequent become ends of pieces; the hashes of all words."""
        hashed = shard.hashes()
        kept = _held(frequent_words.value, hashed)
        shard.words = np.where(kept[shard.words], shard.words, 0)
        shard.split_where(np.zeros(len(shard.words), bool))
        return hashed

    def pairs(shard: Shard):
        rare(shard)
        yield from shard.phrases(2, 2)

    found = merged(texts, pairs, least)
    frequent_pairs = send(bitmap(found))

    def longer(shard: Shard):
        hashed = rare(shard)
        if len(shard.words):
            own = hashed[shard.words]
            shard.split_where(~np.append(_held(frequent_pairs.value, _fold(own[:-1], own[1:])), False))
        yield from shard.phrases(3, longest)

    all_of = words.unionByName(found)
    return all_of if longest == 2 else all_of.unionByName(merged(texts, longer, least))


# --- scores ------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two words and more that are best cut worst, ``top`` of each language."""
    found = counts(docs, least, longest)
    phrases = found.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    text = F.col("phrase").cast("string")
    part = lambda begin, size: F.array_join(F.slice(F.split(text, " "), begin, size), " ").cast("binary")
    # what a longer phrase leaves out: one that is no more frequent than what holds it. One word more is enough, as counts only fall.
    over = phrases.where("words > 2").select("lang", F.explode(F.array(part(1, F.col("words") - 1), part(2, F.col("words") - 1))).alias("phrase"), "a")
    over = over.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = phrases.join(over, ["lang", "phrase"], "left").where("most IS NULL OR 100 * most < 100 * a").drop("most")
    sides = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = sides.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit("l").alias("side"), part(1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))).alias("x"))
    sides = stored(sides.select("lang", "phrase", "a", "k", "x.side", "x.part"), "sides")
    uses = sides.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    one = uses.join(found.where("words > 0").select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    both = join_spread(sides, one, ["lang", "part"], "uses", sides.count())
    value = lambda side: F.max(F.when(F.col("side") == side, F.col("n"))).alias(side)
    cut = both.groupBy("lang", "phrase", "a", "k").agg(value("l"), value("r"))
    total = F.broadcast(found.where("words = 0").select("lang", F.col("n").alias("all")))
    scored = cut.join(total, "lang").select(
        "lang", "phrase", "a", "k", "l", "r", F.col("all").alias("n"), F.expr("CAST(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(all AS DECIMAL(17,0)) AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))").alias("score"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    few = best.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", text.alias("phrase"), "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def _oracle() -> str:
    lists = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i : i + {m - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM p)" for m in range(1, LONGEST + 1))
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM ({lists}) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
o AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(f) AS most FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM c)) GROUP BY ALL),
k AS (SELECT lang, phrase, c.f AS a, w, m, unnest(range(1, m)) AS k FROM c LEFT JOIN o USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * c.f),
s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, (1000 * a * n) // (l.f * r.f) AS score FROM k JOIN t USING (lang)
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1 : k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k + 1 : k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= {TOP}
"""


ORACLE_SQL = _oracle()
