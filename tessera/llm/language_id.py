"""Language ID by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read a window of bytes, one from each end; at every position their states give
the probabilities of the languages. A document is cut into windows that cover the whole text, and its
probabilities are the mean over all its positions. The network is trained here, in numpy, by
backpropagation through time.

Training takes a bounded sample: ``SAMPLE`` labelled documents, of each language as many as of the others where it has so many (so
that a rare one is learned too), those that come first in the order of a hash of their id. A text of more than ``PIECES``
times ``PIECE`` characters gives that many pieces of that length, from places anywhere in the whole text. Only text and label are
used.

Defined cases: a text that is null or holds no letter has the language ``und`` and the score 0; ties go to the
language first in the alphabet; repeated rows get equal answers; very long texts are read whole, window by
window; an empty table gives an empty result; without a single labelled document every row is ``und``;
other columns pass through ``label`` untouched, but for lang_pred and score, which replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import as_bytes, batch
from tessera.llm.sampling import stratified_sample
from tessera.session import small_batches

#: Labelled documents that the network learns from, at most.
SAMPLE = 3000
#: Pieces, and characters of a piece, that one of them gives at most.
PIECES, PIECE = 4, 1024
WINDOW = 128
HIDDEN = 8
UNKNOWN = "und"
#: Windows computed together.
_BATCH = 2048


class Network:
    """Weights of both directions; gates: update, reset, candidate (the reset applied to its recurrent part)."""

    def __init__(self, languages: list[str], rng: np.random.Generator | None = None, hidden: int = HIDDEN):
        self.languages, k = languages, max(1, len(languages))
        rng = rng or np.random.default_rng(0)
        self.inputs = [(rng.standard_normal((3 * hidden, 256)) * 0.3).astype(np.float32) for _ in range(2)]
        self.states = [(rng.standard_normal((3 * hidden, hidden)) * 0.4).astype(np.float32) for _ in range(2)]
        self.out = (rng.standard_normal((k, 2 * hidden)) * 0.3).astype(np.float32)
        self.bias = np.zeros((k, 1), np.float32)
        self.hidden = hidden

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, self.out, self.bias]

    def _read(self, codes: np.ndarray, way: int) -> np.ndarray:
        """codes (time, n) -> states (time, hidden, n), for prediction only."""
        steps, n = codes.shape
        h_size = self.hidden
        inputs = self.inputs[way].copy()
        states = self.states[way].copy()
        inputs[: 2 * h_size] *= 0.5  # a logistic gate is a shifted tanh of half its input
        states[: 2 * h_size] *= 0.5
        out = np.empty((steps, h_size, n), np.float32)
        h, x, g = np.zeros((h_size, n), np.float32), np.empty((3 * h_size, n), np.float32), np.empty((3 * h_size, n), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(inputs, codes[t], axis=1, out=x, mode="clip")
            np.matmul(states, h, out=g)
            gates, new = x[: 2 * h_size], x[2 * h_size :]
            gates += g[: 2 * h_size]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            recurrent = g[2 * h_size :]
            recurrent *= gates[h_size:]
            new += recurrent
            np.tanh(new, out=new)
            new -= h
            new *= gates[:h_size]
            h = np.add(h, new, out=out[t])
        return out

    def window_scores(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """codes (time, n): every position's probabilities, summed over each window's first ``lengths`` positions."""
        ahead, back = self._read(codes, 0), self._read(codes, 1)
        total = np.zeros((len(self.out), codes.shape[1]), np.float32)
        for t in range(len(codes)):
            z = self.out[:, : self.hidden] @ ahead[t] + self.out[:, self.hidden :] @ back[t] + self.bias
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z *= (lengths > t) / z.sum(axis=0)
            total += z
        return total

    def document_scores(self, texts: list[bytes]) -> np.ndarray:
        """(documents, languages): mean probabilities over all positions; 0 for empty texts."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        windows = -(-lengths // WINDOW)
        ends = np.cumsum(windows)
        buffer = np.full(int(ends[-1]) * WINDOW if len(ends) else 0, 32, np.uint8)  # windows are padded with blanks
        for text, at in zip(texts, ((ends - windows) * WINDOW).tolist()):
            buffer[at : at + len(text)] = np.frombuffer(text, np.uint8)
        codes = buffer.reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        used = np.minimum(lengths[owner] - (np.arange(len(owner)) - (ends - windows)[owner]) * WINDOW, WINDOW)
        total = np.zeros((len(texts), len(self.out)))
        for at in range(0, len(codes), _BATCH):
            part = slice(at, at + _BATCH)
            scores = self.window_scores(np.ascontiguousarray(codes[part].T).astype(np.intp), used[part])
            for k in range(len(total[0])):
                total[:, k] += np.bincount(owner[part], scores[k], len(texts))
        return total / np.maximum(lengths, 1)[:, None]


# --- training --------------------------------------------------------------------------------


def _gated(net: Network, codes: np.ndarray, way: int):
    """As Network._read, keeping what the way back needs."""
    steps, n = codes.shape
    s, kept = net.hidden, []
    states = np.zeros((steps, s, n), np.float32)
    h = np.zeros((s, n), np.float32)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        x, g = net.inputs[way][:, codes[t]], net.states[way] @ h
        gates = 0.5 + 0.5 * np.tanh(0.5 * (x[: 2 * s] + g[: 2 * s]))
        new = np.tanh(x[2 * s :] + gates[s:] * g[2 * s :])
        kept.append((t, h, gates, g[2 * s :], new))
        h = h + gates[:s] * (new - h)
        states[t] = h
    return states, kept


def _back(net: Network, codes: np.ndarray, way: int, kept: list, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent matrix. above: those of the states, by time."""
    s = net.hidden
    d_inputs, d_states = np.zeros_like(net.inputs[way]), np.zeros_like(net.states[way])
    d_next = np.zeros_like(above[0])
    for t, h, gates, recurrent, new in reversed(kept):
        d_h = d_next + above[t]
        z, r = gates[:s], gates[s:]
        d_new = d_h * z * (1 - new * new)
        d_z = d_h * (new - h) * z * (1 - z)
        d_r = d_new * recurrent * r * (1 - r)
        d_pre = np.concatenate([d_z, d_r, d_new * r])
        d_in = np.concatenate([d_z, d_r, d_new])
        d_states += d_pre @ h.T
        for row, values in enumerate(d_in):
            d_inputs[row] += np.bincount(codes[t], values, 256)
        d_next = d_h * (1 - z) + net.states[way].T @ d_pre
    return d_inputs, d_states


def loss_and_gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of windows (time, n), and its gradients."""
    steps, n = codes.shape
    s = net.hidden
    runs = [_gated(net, codes, way) for way in range(2)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=1)
    z = net.out @ both + net.bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    picked = p[:, labels, np.arange(n)]
    d = p.copy()
    d[:, labels, np.arange(n)] -= 1
    d /= steps * n
    d_out = np.einsum("tkn,thn->kh", d, both)
    d_both = np.einsum("kh,tkn->thn", net.out, d)
    sides = [_back(net, codes, way, runs[way][1], d_both[:, way * s : (way + 1) * s]) for way in range(2)]
    return float(-np.log(np.maximum(picked, 1e-12)).mean()), [sides[0][0], sides[1][0], sides[0][1], sides[1][1], d_out, d.sum(axis=(0, 2))[:, None]]


def train(examples: list[tuple[bytes, str]], seed: int = 1, rounds: int = 300, size: int = 192, window: int = 32, rate: float = 0.03) -> Network:
    """Adam over windows drawn from the examples, each language as often as the others."""
    languages = sorted({lang for _, lang in examples})
    rng = np.random.default_rng(seed)
    net = Network(languages, rng)
    if len(languages) < 2:
        return net
    own = [[text for text, lang in examples if lang == name] for name in languages]
    means = [np.zeros_like(p) for p in net.parameters]
    squares = [np.zeros_like(p) for p in net.parameters]
    for step in range(1, rounds + 1):
        labels = rng.integers(0, len(languages), size)
        codes = np.full((window, size), 32, np.intp)
        for i, k in enumerate(labels):
            text = own[k][rng.integers(len(own[k]))]
            at = rng.integers(0, max(1, len(text) - window // 2))
            piece = np.frombuffer(text[at : at + window], np.uint8)
            codes[: len(piece), i] = piece
        _, gradients = loss_and_gradients(net, codes, labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        for p, g, m, v in zip(net.parameters, gradients, means, squares):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * min(1.0, 2 - 2 * step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def held_out() -> Column:
    """True for documents that the network never learns from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, sample: int = SAMPLE, pieces: int = PIECES, piece: int = PIECE) -> list[tuple[bytes, str]]:
    """Text and label of ``sample`` labelled documents that aren't held out; of a long text, pieces from anywhere in it."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.col("text") != "")).select("doc_id", "lang", "text")
    at = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length("text") - piece + 1) + 1 for i in range(pieces)]
    some = F.when(F.length("text") <= pieces * piece, F.array("text")).otherwise(F.array(*(F.substring("text", a.cast("int"), F.lit(piece)) for a in at)))
    rows = stratified_sample(known, "lang", sample, 7, "doc_id", "text").orderBy("doc_id", "text").select("lang", some.alias("texts")).collect()
    return [(text.encode(), r["lang"]) for r in rows for text in r["texts"]]


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on ``sample`` labelled documents that aren't held out."""
    return train(examples(docs, sample))


# --- texts of no learned language -----------------------------------------------------------------


class Usual:
    """Whether a text reads like the language that the network found.

    The network shares all probability among the languages it learned, so its score can't tell that a text is of none.
    Here the mean logarithm of the probabilities of a text's bytes, each after the one before it, is held against
    that of learned texts of the same language and length: a text goes if it is below all but ``OUTSIDE`` of those and ``SPREAD``
    deviations (by the median of their distances) below their median. Each learned text is measured by counts of the others. A language with less than
    ``LEAST_TEXTS`` of them can't be judged, and has no bar.
    """

    def __init__(self, learned: list[tuple[bytes, str]], net: Network):
        counts = np.zeros((_FOLDS, len(net.languages), 1 << 16))
        for i, (text, lang) in enumerate(learned):
            counts[i % _FOLDS, net.languages.index(lang)] += np.bincount(_byte_pairs(text), minlength=1 << 16)
        self.tables = [_log_odds(c) for c in counts.sum(axis=0)]
        self.bars = np.full((len(net.languages), len(LENGTHS)), -np.inf)
        found: dict[tuple[int, int], list[float]] = {}
        texts: dict[tuple[int, int], int] = {}
        for fold in range(_FOLDS):
            own = learned[fold::_FOLDS]
            tables = [_log_odds(c) for c in counts.sum(axis=0) - counts[fold]]
            for j, n in enumerate(LENGTHS):
                cuts = [[t[at : at + n] for at in np.linspace(0, len(t) - n, min(_CUTS, len(t) // n)).astype(int)] for t, _ in own if len(t) >= n]
                flat = [c for cut in cuts for c in cut]
                names, _ = predict(net, flat)
                k = [net.languages.index(x) if x != UNKNOWN else -1 for x in names]
                for c, lang in zip(flat, k):
                    if lang >= 0:
                        found.setdefault((lang, j), []).append(_mean_odds(tables[lang], c))
                at = 0
                for cut in cuts:
                    for lang in set(k[at : at + len(cut)]):
                        texts[lang, j] = texts.get((lang, j), 0) + 1
                    at += len(cut)
        for at, values in found.items():
            if texts[at] >= LEAST_TEXTS:
                middle = np.median(values)
                self.bars[at] = min(np.quantile(values, OUTSIDE), middle - SPREAD * 1.4826 * np.median(np.abs(values - middle)))

    def of(self, text: bytes, lang: int) -> bool:
        low = self.bars[lang]
        known = np.flatnonzero(np.isfinite(low))
        if not len(known):
            return True
        return _mean_odds(self.tables[lang], text) >= np.interp(np.log2(len(text)), np.log2(LENGTHS)[known], low[known])


#: Lengths in bytes that a text is judged by; between them the bar is interpolated.
LENGTHS = np.array([4, 8, 16, 32, 64, 128, 256, 512, 1024])
OUTSIDE, SPREAD, LEAST_TEXTS = 0.002, 4.0, 20
_FOLDS, _CUTS = 4, 4


def _byte_pairs(text: bytes) -> np.ndarray:
    data = np.frombuffer(b" " + text, np.uint8).astype(np.uint16)
    return data[:-1] << 8 | data[1:]


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Per pair the logarithm of the second byte's probability after the first; rare pairs lean on the byte alone."""
    alone = counts.reshape(256, 256).sum(axis=0) + 0.5
    after = counts.reshape(256, 256) + 8 * alone / alone.sum()
    return np.log(after / after.sum(axis=1, keepdims=True)).ravel().astype(np.float32)


def _mean_odds(table: np.ndarray, text: bytes) -> float:
    step = 1 << 20
    return sum(float(table[_byte_pairs(text[at : at + step])].sum(dtype=np.float64)) for at in range(0, len(text), step)) / len(text)


# --- labelling ----------------------------------------------------------------------------------


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if text.isascii():
        return not text.isspace() and any(text.count(x) for x in _LETTERS)
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


_LETTERS = [bytes([c]) for c in b"etaonirshdlucmfywgpbvkxqjzETAONIRSHDLUCMFYWGPBVKXQJZ"]


def predict(net: Network, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    readable = [has_letter(t) for t in texts]
    if not net.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    p = net.document_scores([t if ok else b"" for t, ok in zip(texts, readable)])
    best = p.argmax(axis=1)
    names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), readable)]
    return names, np.where(readable, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)


def _labelled(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, usual = shared.value
        place = {name: k for k, name in enumerate(net.languages)}
        for rows in batches:
            texts = as_bytes(rows["text"])
            names, score = predict(net, texts)
            added = {"lang_pred": pa.array(names, pa.string()), "score": score}
            if usual:
                added["usual"] = pa.array([name != UNKNOWN and usual.of(t, place[name]) for t, name in zip(texts, names)], pa.bool_())
            yield batch([*rows.schema.names, *added], [*rows.columns, *added.values()])

    return run


def label(docs: DataFrame, net: Network, usual: Usual | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, and with ``usual`` given also a column of that name."""
    docs = docs.drop("lang_pred", "score", *(["usual"] if usual else []))
    small_batches(docs.sparkSession)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + ([T.StructField("usual", T.BooleanType())] if usual else [])
    return docs.mapInArrow(_labelled(docs.sparkSession.sparkContext.broadcast((net, usual))), T.StructType([*docs.schema, *added]))


def query(docs: DataFrame) -> DataFrame:
    net = learn(docs)
    found = label(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
