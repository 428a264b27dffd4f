"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model's pieces are merged as its own library does: of all neighbours whose joint text is a piece, the best
scored (then leftmost) merge comes next on the agenda. Here a candidate that comes up is skipped for good if a
keyed hash says so. The hash sees the seed, the document's id, the word's place in the document and which candidate of
the word it is, and nothing else, so equal input always gives equal ids, on any machine and in any order, and every
occurrence of a word, in a document or in another, is cut on its own. The hash gives the number of candidates up to
the next that is skipped, which is the same as asking for each.

``variants`` is the number of keys that ids are hashed to; other seeds give other segmentations of the whole
corpus. Words (a run of blanks and what follows it; a run of line ends is one too) are independent, for no piece
of the model goes across their borders; that is checked when the model is loaded. So a task cuts texts into words, numbers
the distinct ones, and computes the ids of a word and the candidates skipped in it once, many words at a time: all words
of a length are rows of one matrix, and one step does the next merge of every row.

Characters without a piece become byte pieces; so does a literal U+2581, which the model would turn into a
blank. Hence every text decodes to itself.

Defined cases: a null or empty text has no ids; a null id has the key 0; repeated rows get equal ids; very long
texts and words without any blank are encoded whole; an empty table gives an empty result; other columns pass through
``encode`` untouched, but for the four that it adds, which replace columns of those names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.arrow import batch
from tessera.session import small_batches

SEED = 20
DROPOUT = 0.1
#: Keys that documents are dealt to: all hashes of 64 bits, so that each document has its own.
VARIANTS = 1 << 64
#: Segmentations that a worker remembers; when there are more, those met once since the last
#: time are forgotten.
MEMORY = 200_000
#: Words longer than this are encoded one at a time.
_WIDE = 48
_BLOCK = 20_000
#: Words segmented together.
_PART = 500_000
#: Gaps between skipped candidates are drawn up to here; more than the candidates of any word up to _WIDE.
_FAR = 1024
#: Pieces decoded together.
_RUN = 1 << 20
_BLANK = "▁"
_STEP = 0x9E3779B97F4A7C15
_M1, _M2, _MASK = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFFFFFFFFFFFFFFFF


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each with a blank before it unless it is empty; where each word starts; and where each text starts,
    with the end of all. A word is a run of blanks and what follows it up to a blank or line end, or a run of line ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    none, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    joined = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), none, blank), texts, none)
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = (data == 32) + 2 * (data == 10).view(np.uint8)
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) & ((kind[1:] != 0) | (kind[:-1] != 1))
    first[ends[:-1][np.diff(ends) > 0]] = True
    return data, np.flatnonzero(first), ends


class Pieces:
    """The vocabulary of a SentencePiece model: its characters, bytes and merges."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(_BLANK in names[i].lstrip(_BLANK) or "\n" in names[i] for i in plain):
            raise ValueError("pieces of this model go across words")
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not model.is_byte(i) for i in self.byte):
            raise ValueError("this model has no byte pieces")
        ids = {names[i]: i for i in plain}
        # per code point its piece, or -1 - the code point
        self.char = -1 - np.arange(0x110000, dtype=np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.char[ord(" " if t == _BLANK else t)] = i
        # the order of merges: by score, best first
        scores = np.array([model.get_score(i) for i in range(self.size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.merges = merges = {ids[t[:k]] * self.size + ids[t[k:]]: i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        made = np.array(sorted(set(merges.values())), np.int64)
        self.by_rank = np.full(int(self.rank.max(initial=0)) + 1, -1, np.int32)
        self.by_rank[self.rank[made]] = made
        self.ranks_differ = len(np.unique(self.rank[made])) == len(made)
        # a hash table in which a key has two places; -1 is free
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.pairs, self.merged = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)
        keys = np.array(sorted(merges), np.int64)
        places = dict(zip(keys.tolist(), zip(*(x.tolist() for x in self._places(keys)))))
        for key, (at, _) in places.items():
            made = merges[key]
            for _ in range(1000):
                key, self.pairs[at] = int(self.pairs[at]), key
                made, self.merged[at] = int(self.merged[at]), made
                if key < 0:
                    break
                at = sum(places[key]) - at
            else:
                raise ValueError("the merges of this model don't fit their table")
        self.text = [names[i].replace(_BLANK, " ").encode() for i in range(self.size)]
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.flat, self.lengths = np.frombuffer(b"".join(self.text), np.uint8), np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece two symbols make, or -1. Negative symbols (characters without a piece) make none."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at, other = self._places(key)
        at = np.where(self.pairs[at] == key, at, other)
        return np.where(self.pairs[at] == key, self.merged[at], -1)

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = key.astype(np.uint64) * np.uint64(_STEP)
        shift = np.uint64(64 - self.bits)
        return (x >> shift).astype(np.int64), ((x ^ (x >> np.uint64(31))) * np.uint64(_M1) >> shift).astype(np.int64)

    def made(self, left: int, right: int) -> int:
        return self.merges.get(left * self.size + right, -1) if left >= 0 and right >= 0 else -1

    def symbols(self, words: list[str]) -> np.ndarray:
        """Words of one length -> (words, characters): pieces, or -1 - code points."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        return self.char[points].reshape(len(words), -1)

    def spelled(self, symbols: list[int]) -> list[int]:
        """Piece ids of symbols: those without a piece become bytes."""
        out = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            else:
                out += [self.byte[b] for b in chr(-1 - s).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text, without the blank that stands before every text."""
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")[1:] if ids else ""

    def lossless(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each text's ids, decoded, are its bytes (of ``cut``)."""
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        long = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths[ids])])
        same = np.diff(long[after]) == np.diff(ends)
        if not same.all():
            for t in np.flatnonzero(same).tolist():
                own = ids[after[t] : after[t + 1]]
                same[t] = np.array_equal(self.flat[_spans(self.starts[own], self.lengths[own])], data[ends[t] : ends[t + 1]])
            return same
        for at in range(0, len(ids), _RUN):
            own = ids[at : at + _RUN]
            wrong = np.flatnonzero(self.flat[_spans(self.starts[own], self.lengths[own])] != data[long[at] : long[at + len(own)]])
            same[np.searchsorted(ends, long[at] + wrong, "right") - 1] = False
        return same


class Dropout:
    """Segmentations under one seed. rate: the share of candidates that are skipped.

    What is remembered is a tree a word: a node is a word and the candidates that were skipped so far, by their number in
    the order they came up (``mark``: the last of them; the others are its parents'). It knows the ids if no more are skipped and
    how many candidates would still come up then (``reach``); its child ``gap`` is the node where the one after ``gap`` of those is
    skipped too.
    """

    def __init__(self, pieces: Pieces, seed: int = SEED, rate: float = DROPOUT, variants: int = VARIANTS):
        self.pieces, self.variants = pieces, variants
        self.key = np.uint64(xxhash.xxh64_intdigest(str(seed).encode(), 0))
        # gap > k for hashes of 53 bits below the k-th of these; products only, for equal numbers on any machine
        odds = np.multiply.accumulate(np.full(_FAR, 1.0 - rate)) * 2.0**53
        self.odds = odds.astype(np.int64)[::-1].copy()
        self._forget()

    def _forget(self) -> None:
        self.roots: dict[str, int] = {}
        self.names: list[str] = []
        self.word, self.parent, self.mark, self.depth, self.reach, self.at, self.size, self.kids, self.hits = (np.zeros(0, np.int64) for _ in range(9))
        self.child, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget_rare(self) -> None:
        """Keep the nodes met twice or more since the last time, if those are few; a node's parent is met as often."""
        keep = np.flatnonzero(self.hits > 1)
        sizes, reach = self.size[keep], self.reach[keep]
        if len(keep) > MEMORY // 2 or sizes.sum() > 8 * MEMORY:
            return self._forget()
        name = np.full(len(self.hits) + 1, -1)  # the last is for nodes that aren't there
        name[keep] = np.arange(len(keep))
        self.roots = {w: i for w, i in zip(self.roots, name[list(self.roots.values())].tolist()) if i >= 0}
        used, self.word = np.unique(self.word[keep], return_inverse=True)
        self.names = [self.names[i] for i in used.tolist()]
        self.parent, self.mark, self.depth = name[self.parent[keep]], self.mark[keep], self.depth[keep]
        self.ids, self.child = self.ids[_spans(self.at[keep], sizes)], name[self.child[_spans(self.kids[keep], reach)]]
        self.at, self.kids, self.size, self.reach = np.cumsum(sizes) - sizes, np.cumsum(reach) - reach, sizes, reach
        self.hits = np.zeros(len(keep), np.int64)

    def variant(self, doc_id: int | None) -> int:
        return 0 if doc_id is None else xxhash.xxh64_intdigest(str(doc_id).encode(), 1) % self.variants

    def _salts(self, variants: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The key of a word at a place of a document."""
        return _mix(_mix(variants ^ self.key) + places.astype(np.uint64) * np.uint64(_STEP))

    def _gaps(self, salts: np.ndarray, draws: int | np.ndarray) -> np.ndarray:
        """How many candidates are not skipped before the next that is; ``_FAR``: at least so many, then draw again."""
        hashed = _mix(salts ^ (np.asarray(draws + 1).astype(np.uint64) * np.uint64(_M2))) >> np.uint64(11)
        return _FAR - np.searchsorted(self.odds, hashed.astype(np.int64), side="right")

    def one(self, word: str, variant: int, place: int = 0) -> list[int]:
        """A word by an agenda in a heap."""
        return self._agenda(word, self._salts(np.array([variant], np.uint64), np.array([place])))

    def _drawn(self, salt: np.ndarray) -> Iterator[int]:
        at = 0
        while True:
            yield from self._gaps(salt, np.arange(at, at + 64)).tolist()
            at += 64

    def _agenda(self, word: str, salt: np.ndarray) -> list[int]:
        pieces, sym = self.pieces, self.pieces.symbols([word])[0].tolist()
        n = len(sym)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        drawn = self._drawn(salt)
        gap = next(drawn)
        more = gap == _FAR

        def candidate(i: int):
            j = after[i]
            made = pieces.made(sym[i], sym[j]) if j >= 0 else -1
            return None if made < 0 else (int(pieces.rank[made]), i, sym[i], sym[j], made)

        agenda = [c for i in range(n) if (c := candidate(i))]
        heapify(agenda)
        while agenda:
            _, i, left, right, made = heappop(agenda)
            j = after[i]
            if not alive[i] or j < 0 or sym[i] != left or sym[j] != right:
                continue
            while gap == 0 and more:
                gap = next(drawn)
                more = gap == _FAR
            if gap == 0:
                gap = next(drawn)
                more = gap == _FAR
                continue
            gap -= 1
            sym[i], alive[j] = made, False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (c := candidate(k)):
                    heappush(agenda, c)
        return pieces.spelled([s for s, ok in zip(sym, alive) if ok])

    def _merged(self, words: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of one length, all of them a merge at a time, skipping the candidates of these numbers (a row a word, -1 after
        the last): their ids one after the other, how many each has, and how many candidates came up."""
        pieces = self.pieces
        n, none = len(words), np.iinfo(np.int32).max
        symbols = pieces.symbols(words)
        row = np.arange(n)
        came, turn, sizes = (np.zeros(n, np.int64) for _ in range(3))
        done, odd = [], {}

        def ranked(left, right):
            made = pieces.lookup(left, right)
            return np.where(made >= 0, pieces.rank[made], none)

        def finish(rows, matrix):
            sizes[rows] = matrix.shape[1]
            fits = (matrix >= 0).all(axis=1)
            if not fits.all():
                for r, line in zip(rows[~fits].tolist(), matrix[~fits].tolist()):
                    odd[r] = pieces.spelled(line)
                    sizes[r] = len(odd[r])
                rows, matrix = rows[fits], matrix[fits]
            done.append((rows, matrix))

        order = ranked(symbols[:, :-1], symbols[:, 1:])
        while len(row) and symbols.shape[1] > 1:
            best = order.argmin(axis=1)
            worth = order[np.arange(len(row)), best]
            skip = np.flatnonzero((worth != none) & (skips[row, turn[row]] == came[row]))
            while len(skip):
                order[skip, best[skip]] = none
                came[row[skip]] += 1
                turn[row[skip]] += 1
                best[skip] = order[skip].argmin(axis=1)
                worth[skip] = order[skip, best[skip]]
                skip = skip[(worth[skip] != none) & (skips[row[skip], turn[row[skip]]] == came[row[skip]])]
            over = worth == none
            if over.any():
                finish(row[over], symbols[over])
                keep = ~over
                row, symbols, order, best, worth = row[keep], symbols[keep], order[keep], best[keep], worth[keep]
                if not len(row):
                    break
            came[row] += 1
            every, width = np.arange(len(row)), symbols.shape[1]
            symbols[every, best] = pieces.by_rank[worth] if pieces.ranks_differ else pieces.lookup(symbols[every, best], symbols[every, best + 1])
            column = np.arange(width)
            symbols = symbols[column != (best + 1)[:, None]].reshape(len(row), width - 1)
            order = order[column[:-1] != best[:, None]].reshape(len(row), width - 2)
            # the merged symbol's new neighbours on the left and on the right
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
            r, c = np.concatenate([left, right]), np.concatenate([best[left] - 1, best[right]])
            order[r, c] = ranked(symbols[r, c], symbols[r, c + 1])
        if len(row):
            finish(row, symbols)
        start = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.int32)
        for rows, matrix in done:
            ids[start[rows][:, None] + np.arange(matrix.shape[1])] = matrix
        for r, line in odd.items():
            ids[start[r] : start[r] + len(line)] = line
        return ids, sizes, came

    def many(self, words: list[str], variant: int, place: int = 0) -> list[bytes]:
        """Words at one place of a document; their ids as little-endian 32-bit integers."""
        unique = list(dict.fromkeys(words))
        index = np.array([unique.index(w) for w in words], np.int64)
        ids, sizes = self._segmented(unique, index, self._salts(np.full(len(words), variant, np.uint64), np.full(len(words), place)))
        ends = np.cumsum(sizes)
        return [ids[a:b].astype("<i4").tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]

    def _add(self, word: np.ndarray, parent: np.ndarray, mark: np.ndarray, depth: np.ndarray, ids: np.ndarray, size: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """New nodes, and their numbers."""
        first = len(self.word)
        new = {"word": word, "parent": parent, "mark": mark, "depth": depth, "reach": reach, "size": size, "hits": np.zeros(len(word), np.int64)}
        new |= {"at": len(self.ids) + np.cumsum(size) - size, "kids": len(self.child) + np.cumsum(reach) - reach, "child": np.full(int(reach.sum()), -1), "ids": ids}
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        return np.arange(first, first + len(word))

    def _paths(self, parent: np.ndarray, mark: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The numbers of the candidates skipped, a row a node, -1 after the last."""
        out = np.full((len(parent), int(depth.max(initial=0)) + 1), -1)
        rows = np.flatnonzero(depth > 0)
        out[rows, depth[rows] - 1] = mark[rows]
        above = parent[rows]
        while len(rows):
            some = self.depth[above] > 0
            rows, above = rows[some], above[some]
            out[rows, self.depth[above] - 1] = self.mark[above]
            above = self.parent[above]
        return out

    def _learn(self, word: np.ndarray, parent: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """New nodes of words that aren't too long for a matrix, and their numbers. A root has the parent and mark -1."""
        names = [self.names[i] for i in word.tolist()]
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        depth = np.zeros(len(word), np.int64)
        depth[parent >= 0] = self.depth[parent[parent >= 0]] + 1
        sizes, reach, found = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), []
        by_length = np.argsort(lengths, kind="stable")
        for group in np.split(by_length, np.flatnonzero(np.diff(lengths[by_length])) + 1):
            for at in range(0, len(group), _BLOCK):
                part = group[at : at + _BLOCK]
                ids, sizes[part], came = self._merged([names[i] for i in part.tolist()], self._paths(parent[part], mark[part], depth[part]))
                reach[part] = came - mark[part] - 1
                found.append((part, ids))
        start, flat = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.int32)
        for part, ids in found:
            flat[_spans(start[part], sizes[part])] = ids
        return self._add(word, parent, mark, depth, flat, sizes, reach)

    def _segmented(self, unique: list[str], index: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (numbers in ``unique``) under their salts, one after the other, and how many each has."""
        if len(self.word) > MEMORY or len(self.ids) > 16 * MEMORY:
            self._forget_rare()
        root = np.fromiter(map(self.roots.get, unique, repeat(-2)), np.int64, len(unique))  # -1: too long for a matrix
        new = np.flatnonzero(root == -2)
        if len(new):
            names = [unique[i] for i in new.tolist()]
            short = np.fromiter(map(len, names), np.int64, len(names)) <= _WIDE
            first = len(self.names)
            self.names += [w for w, ok in zip(names, short.tolist()) if ok]
            none = np.full(len(self.names) - first, -1)
            root[new] = -1
            root[new[short]] = self._learn(np.arange(first, len(self.names)), none, none)
            self.roots.update(zip(names, root[new].tolist()))
        node = root[index]
        wide = np.flatnonzero(node < 0)
        if len(wide):
            lists = [self._agenda(unique[index[i]], salts[i : i + 1]) for i in wide.tolist()]
            zero, none = np.zeros(len(lists), np.int64), np.full(len(lists), -1)
            if not self.names:
                self.names.append("")
            node[wide] = self._add(zero, none, none, zero, np.concatenate([np.array(x, np.int32) for x in lists]), np.array([len(x) for x in lists], np.int64), zero)
        live, draw = np.arange(len(index)), 0
        self.hits += np.bincount(node, minlength=len(self.hits))
        while len(live):
            gap = self._gaps(salts[live], draw)
            goes = gap < self.reach[node[live]]
            live, gap = live[goes], gap[goes]
            slot = self.kids[node[live]] + gap
            missing = np.flatnonzero(self.child[slot] < 0)
            if len(missing):
                empty, at = np.unique(slot[missing], return_index=True)
                parent = node[live[missing[at]]]
                made = self._learn(self.word[parent], parent, self.mark[parent] + 1 + gap[missing[at]])
                self.child[empty] = made
            node[live] = self.child[slot]
            self.hits += np.bincount(node[live], minlength=len(self.hits))
            draw += 1
        size = self.size[node]
        return self.ids[_spans(self.at[node], size)], size

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (as ``cut`` gives them), one after the other, and how many each has."""
        offsets = np.append(starts, len(data))
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        unique, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        first = np.searchsorted(starts, ends)
        counts = np.diff(first)
        own = np.array([self.variant(d) for d in doc_ids], np.uint64)
        salts = self._salts(np.repeat(own, counts), np.arange(len(index)) - np.repeat(first[:-1], counts))
        parts = []
        for at in range(0, len(index), _PART):
            some, place = (unique, index) if len(index) <= _PART else np.unique(index[at : at + _PART], return_inverse=True)
            parts.append(self._segmented(some if some is unique else [unique[i] for i in some.tolist()], place, salts[at : at + _PART]))
        ids = np.concatenate([np.zeros(0, np.int32), *(p for p, _ in parts)]).astype("<i4", copy=False)
        after = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))])
        return ids, np.diff(after[first])

    def encode(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers."""
        ids, sizes = self.segment(*cut(pa.array(texts, pa.string())), list(doc_ids))
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def _coder(path: str, seed: int, rate: float, variants: int) -> Dropout:
    """One for all tasks of a Python worker; what it remembers changes its speed, not its ids."""
    return Dropout(_pieces(path), seed, rate, variants)


def _encoded(path: str, seed: int, rate: float, variants: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, seed, rate, variants)
        for rows in batches:
            data, starts, ends = cut(rows["text"])
            ids, sizes = coder.segment(data, starts, ends, rows["doc_id"].to_pylist())
            after = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(after[:-1].tolist(), after[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(after.astype(np.int32)), pa.array(ids))
            same = coder.pieces.lossless(ids, sizes, data, ends)
            yield batch([*rows.schema.names, *_ADDED.names], [*rows.columns, lists, sizes, pa.array(sums, pa.int64()), pa.array(same, pa.bool_())])

    return run


_ADDED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())
])


def encode(docs: DataFrame, model: str, seed: int = SEED, rate: float = DROPOUT, variants: int = VARIANTS) -> DataFrame:
    """``docs`` with ids (array<int>), n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers) and lossless:
    whether the ids, decoded, are the text."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*_ADDED.names)
    return docs.mapInArrow(_encoded(model, seed, rate, variants), T.StructType([*docs.schema, *_ADDED]))


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for rows in batches:
            texts = [pieces.decode(ids or []) for ids in rows["ids"].to_pylist()]
            yield batch([*rows.schema.names, "decoded"], [*rows.columns, pa.array(texts, pa.string())])

    return run


def decode(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with the column decoded: the text of ids."""
    small_batches(rows.sparkSession)
    rows = rows.drop("decoded")
    return rows.mapInArrow(_decoded(model), T.StructType([*rows.schema, T.StructField("decoded", T.StringType())]))


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    rows = encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_pieces", "ids_crc32", "lossless")
