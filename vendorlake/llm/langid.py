"""Language ID by a linear-chain conditional random field over the words of a text.

Each word has affix features (its first and last one to three bytes), n-gram features (its byte trigrams, with marks at
either end) and a lexicon feature (the word itself), hashed into 2**BITS weights a language; learned transitions join
neighbouring words, so words of code-switched text are labelled by forward-backward in their context. A text's language
is the one with the greatest mean posterior over its words, and the score is that mean.

Fitting takes a bounded sample: FIT_ROWS labelled documents (those of the smallest hashed ids, one text an id), each cut
into runs of RUN words. Runs of different documents are strung together, so that the chain sees languages change and its
transitions are learned.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship
from .wordhash import _LOWER, Words, carried, pieces

BITS = 18
FIT_ROWS, RUN, STRUNG = 1000, 32, 4
#: Bytes of text that are labelled together, and of those whose features are held at once.
PIECE, FEATURED = 4 << 20, 1 << 18
UNKNOWN = "und"
#: ASCII letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code + np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int32)


def features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) pairs by kind of feature; a kind has a word once, but for the n-grams."""
    low = _LOWER[words.data].astype(np.uint64)
    start, end = words.start, words.end
    length = end - start
    with np.errstate(over="ignore"):
        out = [(np.arange(len(start)), _bucket(words.numbers() >> np.uint64(8), 1))]
    for k in (1, 2, 3):
        some = np.flatnonzero(length >= k)
        head, tail = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
        for i in range(k):
            head = head << np.uint64(8) | low[start[some] + i]
            tail = tail << np.uint64(8) | low[end[some] - k + i]
        out += [(some, _bucket(head, 1 + k)), (some, _bucket(tail, 4 + k))]
    # Trigrams around every byte, the word's neighbours being 0.
    total = int(length.sum())
    word = np.repeat(np.arange(len(start)), length)
    at = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
    pad = np.concatenate([low, np.zeros(1, np.uint64)])
    before = np.where(at > start[word], pad[at - 1], 0)
    after = np.where(at + 1 < end[word], pad[np.minimum(at + 1, len(low))], 0)
    out.append((word, _bucket(before << np.uint64(16) | pad[at] << np.uint64(8) | after, 8)))
    return out


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    n = len(words.start)
    out = np.zeros((n, weights.shape[1]))
    *single, (word, bucket) = features(words)
    for some, b in single:
        out[some] += weights[b]
    for c in range(weights.shape[1]):
        out[:, c] += np.bincount(word, weights[bucket, c], minlength=n)
    return out


def posteriors(emission: np.ndarray, first: np.ndarray, begin: np.ndarray, move: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward: of each word the languages' probabilities, for all texts at once; text d has words first[d]:first[d + 1].

    moves: gets the expected number of each transition added, if given.
    """
    begin, move = begin.astype(emission.dtype), move.astype(emission.dtype)
    psi = np.exp(emission - emission.max(1, keepdims=True)) + emission.dtype.type(1e-30)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    starts, sizes = first[:-1][order], length[order]
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # texts with more than t words
    forward = np.empty_like(psi)
    state = None
    for t, k in enumerate(alive.tolist()):
        at = starts[:k] + t
        state = (np.broadcast_to(begin, (k, len(begin))) if t == 0 else state[:k] @ move) * psi[at]
        state /= state.sum(1, keepdims=True)
        forward[at] = state
    back = np.ones((0, len(begin)), emission.dtype)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = starts[:k] + t
        if len(back) < k:
            back = np.concatenate([back, np.ones((k - len(back), len(begin)), emission.dtype)])
        seen = psi[at] * back
        if moves is not None and t:
            pair = forward[at - 1][:, :, None] * move[None] * seen[:, None, :]
            moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        forward[at] *= back
        back = seen @ move.T
        back /= back.sum(1, keepdims=True)
    return forward / forward.sum(1, keepdims=True)


class Crf:
    def __init__(self, langs: list[str], weights: np.ndarray, begin: np.ndarray, move: np.ndarray):
        self.langs, self.weights, self.begin, self.move = langs, weights, begin, move

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's first word (and the end), whether that word begins with an ASCII letter, and each word's posteriors.

        Features are made for FEATURED bytes of text at a time (or one longer text); only the posteriors of all are held.
        """
        n_words, ascii_, found = [np.zeros(1, np.int64)], [], [np.zeros((0, len(self.langs)), np.float32)]
        for part in pieces([pa.RecordBatch.from_arrays([texts], ["text"])], size=FEATURED):
            words = Words(part.column("text"), LETTERS)
            n_words.append(np.diff(words.first))
            begins = np.append(words.data[words.start], np.uint8(0xFF))
            ascii_.append((begins[words.first[:-1]] < 0x80) & (n_words[-1] > 0))
            if len(words.start):
                found.append(emissions(words, self.weights).astype(np.float32))
        first = np.cumsum(np.concatenate(n_words))
        emission = np.concatenate(found)
        return first, np.concatenate([np.zeros(0, bool), *ascii_]), posteriors(emission, first, self.begin, self.move) if len(emission) else emission


def fit_crf(texts: list[str], langs: list[str], epochs: int = 5, batches: int = 12, rate: float = 0.08, seed: int = 7) -> Crf | None:
    """From short runs of words and their languages; None without any."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    if not names:
        return None
    # One order whatever order the rows came in.
    order = sorted(range(len(texts)), key=lambda i: (texts[i], langs[i]))
    order = [order[i] for i in rng.permutation(len(order))]
    strung = [order[i : i + STRUNG] for i in range(0, len(order), STRUNG)]
    code = {x: i for i, x in enumerate(names)}
    c, size = len(names), 1 << BITS
    weights, begin, move = np.zeros((size, c)), np.zeros(c), np.zeros((c, c))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, begin, move)]
    prepared = []
    for k in range(min(batches, len(strung))):
        own = strung[k::batches]
        words = Words(pa.array([texts[i] for s in own for i in s], pa.large_string()), LETTERS)
        each = np.diff(words.first)
        truth = np.repeat([code[langs[i]] for s in own for i in s], each)
        first = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum([len(s) for s in own])])]
        prepared.append((features(words), truth, first))
    step = 0
    for _ in range(epochs):
        for pairs, truth, first in prepared:
            n = len(truth)
            if not n:
                continue
            emission = np.zeros((n, c))
            for word, bucket in pairs:
                for j in range(c):
                    emission[:, j] += np.bincount(word, weights[bucket, j], minlength=n)
            trans = np.exp(move - move.max())
            expected = np.zeros((c, c))
            error = posteriors(emission, first, np.exp(begin - begin.max()), trans, expected) - np.eye(c)[truth]
            grad = np.zeros_like(weights)
            for word, bucket in pairs:
                for j in range(c):
                    grad[:, j] += np.bincount(bucket, error[word, j], minlength=size)
            inner = np.ones(n, bool)
            inner[first[:-1][first[:-1] < n]] = False
            b = np.flatnonzero(inner)
            seen = np.zeros((c, c))
            np.add.at(seen, (truth[b - 1], truth[b]), 1)
            heads = first[:-1][np.diff(first) > 0]
            step += 1
            for x, g, (m, v), l2 in zip((weights, begin, move), (grad, error[heads].sum(0), expected - seen), moments, (1e-2, 1.0, 1.0), strict=True):
                g = (g + l2 * x) / len(heads)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(names, weights.astype(np.float32), np.exp(begin - begin.max()), np.exp(move - move.max()))


def _runs(texts: list[str], langs: list[str]) -> tuple[list[str], list[str]]:
    """The texts cut into runs of RUN words."""
    out = []
    words = Words(pa.array(texts, pa.large_string()), LETTERS)
    for a, b, lang in zip(words.first[:-1].tolist(), words.first[1:].tolist(), langs, strict=True):
        for at in range(a, b, RUN):
            out.append((words.data[words.start[at] : words.end[min(at + RUN, b) - 1]].tobytes().decode("utf-8", "replace"), lang))
    return [t for t, _ in out], [x for _, x in out]


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, langs = [], []
    for batch in batches:
        texts += [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        langs += batch.column("lang").to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_crf(*_runs(texts, langs)))], pa.binary())], ["model"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Crf | None:
    """A model of the languages of docs' lang_col, from at most fit_rows documents with text, language and id; None if there is none.

    Of rows that repeat an id the one of the least text and language counts, so that fit_rows texts at most reach the task that
    fits; the driver gets the model alone.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where("id is not null and lang is not null and text is not null")
    ship(docs.sparkSession)
    chosen = d.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = d.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("m"))
    model = rows.select(F.col("m.text").cast("binary").alias("text"), "m.lang").coalesce(1).mapInArrow(_fitted, "model binary").first()
    return None if model is None else pickle.loads(model["model"])


def _identified(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        crf: Crf | None = shared.value
        for batch in pieces(batches, size=PIECE):
            rows = batch.num_rows
            langs, scores, switches, n_words = [UNKNOWN] * rows, np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            if crf is not None:
                texts = batch.column("text")
                first, ascii_, p = crf.label(texts)
                best = p.argmax(1)
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0, dtype=float)])
                changed = np.concatenate([[0, 0], np.cumsum(best[1:] != best[:-1])]) if len(best) else np.zeros(2, int)
                n_words = np.diff(first)
                for d in np.flatnonzero(n_words).tolist():
                    a, b = first[d], first[d + 1]
                    if not ascii_[d] and not any(map(str.isalpha, texts[d].as_py())):
                        continue
                    mean = (total[b] - total[a]) / (b - a)
                    k = int(mean.argmax())
                    langs[d], scores[d], switches[d] = crf.langs[k], min(1.0, max(0.0, mean[k])), changed[b] - changed[a + 1]
            yield batch, [pa.array(langs, pa.string()), pa.array(scores), pa.array(n_words.astype(np.int64)), pa.array(switches.astype(np.int64))]

    return run


def identify(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, the columns of keep, lang_pred (string), score (double, 0 to 1), n_words (long),
    n_switches (long: neighbouring words of different languages).

    Null texts, texts without a letter, and every text where crf is None get "und" with score 0. Null ids stay null;
    repeated rows come out as often as they came in; columns not named, whatever their names, are ignored.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(crf)
    return carried(docs, id_col, text_col, keep, _identified(shared), "lang_pred string, score double, n_words long, n_switches long")
