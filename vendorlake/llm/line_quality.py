"""Quality rules by line sequence labelling: Viterbi decoding of a linear-chain conditional random field marks each line as
content or boilerplate, and the share of a document's characters in content lines decides whether it is kept.

A line is what stands between line feeds; lines without a word have no label. Its features are shares and counts in steps
(words, letters per word, capitals, digits, symbols, marks, words of repeated three-word windows) and flags (repeats an
earlier line, ends like a sentence). Neighbouring labels are joined by learned transitions, so that an odd line within
running text counts with its surroundings.

No line has a label of its own: in fitting, each line takes the label of its document, and runs of lines of several documents
are strung together, so that the chain sees labels change. The sample is bounded: FIT_ROWS labelled documents (those of the
smallest hashed ids, one text an id), and of their runs of RUN lines FIT_RUNS at most, by a hash as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import posteriors
from .shipping import ship
from .wordhash import carried, mix, pieces
from .wordlists import word_lists

FIT_ROWS, FIT_RUNS, RUN, STRUNG = 2000, 8000, 16, 4
#: Bytes of text that are judged together (or one longer text).
PIECE = 2 << 20
LEAST_WORDS, MOST_REPEATED, LEAST_CONTENT = 50, 50, 0.5
CONTENT = 1


def _table(codes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(codes)] = 1
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = _table(range(65, 91)), _table(range(97, 123)), _table(range(48, 58))
_MARK = _table(x for x in range(33, 127) if not chr(x).isalnum() and not _SYMBOL[x])
_SPACE = _table([0x20, *range(0x09, 0x0E)])
_POINT = _table(x for x in range(256) if not 0x80 <= x < 0xC0) & (1 - _SPACE)  # bytes that begin a code point of a word
_SENTENCE_END = _table(b".!?:;\"')")
#: The steps of each share or count; a feature has one bucket more than edges.
EDGES = (
    np.array([2, 4, 8, 16, 32, 64]),  # words
    np.array([2, 3, 4, 5, 6, 8, 12]),  # code points a word
    np.array([0.001, 0.05, 0.2, 0.5, 0.8]),  # capitals among ASCII letters
    np.array([0.001, 0.02, 0.1, 0.3]),  # digits
    np.array([0.0001, 0.005, 0.02, 0.05, 0.1, 0.2]),  # symbols
    np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.3]),  # other marks
    np.array([0.001, 0.1, 0.3, 0.6, 0.9]),  # words of repeated windows
    np.array([0.5]),  # repeats an earlier line
    np.array([0.5]),  # ends like a sentence
)
_BASE = np.concatenate([[0], np.cumsum([len(e) + 1 for e in EDGES])])
KINDS = len(EDGES)


@dataclass
class Counted:
    """What some texts hold: by text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; by line with a word its characters and buckets (lines x KINDS); each text's first such line (and the end)."""

    by_text: np.ndarray
    chars: np.ndarray
    buckets: np.ndarray
    first: np.ndarray


def _repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word stands in a window of three words that its text has twice or more."""
    n, text = len(words), np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    out = np.zeros(n, bool)
    if n < 3:
        return out
    with np.errstate(over="ignore"):
        code = mix(text + np.uint64(1))
        w = words.astype(np.uint64) + np.uint64(1)
        window = code[:-2]
        for k in range(3):
            window = mix(window * np.uint64(0x9E3779B97F4A7C15) + w[k : n - 2 + k])
    at = np.flatnonzero(text[:-2] == text[2:])
    _, which, count = np.unique(window[at], return_inverse=True, return_counts=True)
    at = at[count[which] > 1]
    for k in range(3):
        out[at + k] = True
    return out


def counted(texts: pa.Array) -> Counted:
    whole, _, words, first = word_lists(texts)
    repeated = _repeated(words, first)
    n_dup, again, n_lines = np.zeros(len(whole), np.int64), [], np.zeros(len(whole), np.int64)
    starts, at, total = [], 0, 0
    for d, text in enumerate(whole):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line and not line.isspace():
                again.append(line in seen)
                seen.add(line)
                starts.append(at)
            at += len(line) + 1
        n_lines[d], n_dup[d], total = len(again) - total, sum(again[total:]), len(again)
    data = np.frombuffer(b"\n".join(whole), np.uint8)
    start = np.array(starts, np.int64)
    line_first = np.concatenate([[0], np.cumsum(n_lines)])
    if not starts:
        return Counted(np.zeros((len(whole), 5), np.int64), np.zeros(0, np.int64), np.zeros((0, KINDS), np.int32), line_first)

    def per_line(table: np.ndarray) -> np.ndarray:
        # Between one line and the next stand white space and line feeds alone, which no table counts.
        return np.add.reduceat(table[data], start, dtype=np.int64)

    points, symbols = per_line(_POINT), per_line(_SYMBOL)
    # Word starts tell how many words a line has, and which.
    inside = _SPACE[data] == 0
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]]))
    word_at = np.searchsorted(begins, start)
    word_end = np.append(word_at[1:], len(begins))
    n_words = word_end - word_at
    running = np.concatenate([[0], np.cumsum(repeated)])
    upper, lower = per_line(_UPPER), per_line(_LOWER)
    each = np.maximum(points, 1)
    values = (
        n_words, points / np.maximum(n_words, 1), upper / np.maximum(upper + lower, 1), per_line(_DIGIT) / each, symbols / each, per_line(_MARK) / each,
        (running[word_end] - running[word_at]) / np.maximum(n_words, 1), np.array(again, float), _SENTENCE_END[data[stops[word_end - 1]]],
    )
    buckets = np.stack([np.searchsorted(e, v, "right") + b for e, v, b in zip(EDGES, values, _BASE[:-1], strict=True)], 1).astype(np.int32)

    def per_text(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])

    by_text = np.stack([np.diff(first), per_text(points, line_first), per_text(symbols, line_first), n_dup, per_text(repeated, first)], 1).astype(np.int64)
    return Counted(by_text, points, buckets, line_first)


class Crf:
    """Log weights: of each bucket and label, of a first label, and of a label after a label."""

    def __init__(self, weights: np.ndarray, begin: np.ndarray, move: np.ndarray):
        self.weights, self.begin, self.move = weights, begin, move

    def emissions(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[buckets].sum(1)

    def labels(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return viterbi(self.emissions(buckets), first, self.begin, self.move)


def viterbi(emission: np.ndarray, first: np.ndarray, begin: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest labels of each text's lines, for all texts at once; text d has lines first[d]:first[d + 1]. Of equal paths the one with the smaller label at the latest place where they differ."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    starts, sizes = first[:-1][order], length[order]
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")  # texts with more than t lines
    back, labels = np.zeros(emission.shape, np.int8), np.zeros(len(emission), np.int8)
    ends = np.zeros(len(sizes), np.int64)
    score = np.zeros((0, len(begin)))
    for t, k in enumerate(alive.tolist()):
        at = starts[:k] + t
        if t == 0:
            score = begin + emission[at]
        else:
            ends[k : len(score)] = score[k:].argmax(1)
            paths = score[:k, :, None] + move[None]
            back[at] = paths.argmax(1)
            score = paths.max(1) + emission[at]
    ends[: len(score)] = score.argmax(1) if len(score) else 0
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = starts[:k] + t
        labels[at] = ends[:k]
        ends[:k] = back[at, ends[:k]]
    return labels


def fit_crf(runs: list[tuple[np.ndarray, int]], steps: int = 150, rate: float = 0.1, seed: int = 7) -> Crf | None:
    """From runs of lines (buckets, lines x KINDS) and their labels, by gradient ascent on the likelihood; None without any."""
    runs = [(b, y) for b, y in runs if len(b)]
    if not runs:
        return None
    order = sorted(range(len(runs)), key=lambda i: (runs[i][1], runs[i][0].tobytes()))  # one order whatever order the rows came in
    order = [order[i] for i in np.random.default_rng(seed).permutation(len(order))]
    buckets = np.concatenate([runs[i][0] for i in order])
    each = np.array([len(runs[i][0]) for i in order])
    truth = np.repeat([runs[i][1] for i in order], each)
    first = np.concatenate([[0], np.cumsum(each)])
    first = np.append(first[:-1:STRUNG], first[-1])
    heads, inner = first[:-1], np.setdiff1d(np.arange(1, len(truth)), first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    weights, begin, move = np.zeros((_BASE[-1], 2)), np.zeros(2), np.zeros((2, 2))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (weights, begin, move)]
    for step in range(1, steps + 1):
        expected = np.zeros((2, 2))
        error = posteriors(weights[buckets].sum(1), first, np.exp(begin), np.exp(move), expected) - np.eye(2)[truth]
        grad = np.stack([sum(np.bincount(buckets[:, k], error[:, c], minlength=_BASE[-1]) for k in range(KINDS)) for c in (0, 1)], 1)
        for x, g, (m, v) in zip((weights, begin, move), (grad, error[heads].sum(0), expected - seen), moments, strict=True):
            g = (g + 1e-1 * x) / len(heads)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(weights, begin, move)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of RUN lines of each text: id, at (the run's number), label, buckets (a line's after another's)."""
    for batch in pieces(batches, size=PIECE):
        found = counted(batch.column("text"))
        ids, at, labels, rows = [], [], [], []
        for d, (i, label) in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            for k, a in enumerate(range(found.first[d], found.first[d + 1], RUN)):
                ids.append(i)
                at.append(k)
                labels.append(label)
                rows.append(found.buckets[a : min(a + RUN, found.first[d + 1])].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(at, pa.int64()), pa.array(labels, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["id", "at", "label", "buckets"])


def fit(labels: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS, fit_runs: int = FIT_RUNS) -> Crf | None:
    """A model from the documents whose ids labels marks as of quality (1) or not (0); None without any line of either.

    Rows with a null id or label are left out; of several labels of an id the smallest counts, of several texts the least.
    """
    ship(docs.sparkSession)
    marked = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = marked.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    d = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    d = d.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    runs = d.mapInArrow(_runs, "id string, at long, label int, buckets array<int>").orderBy(F.xxhash64("id", "at"), "id", "at").limit(fit_runs)
    return fit_crf([(np.array(r["buckets"], np.int32).reshape(-1, KINDS), r["label"]) for r in runs.select("buckets", "label").collect()])


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        crf: Crf | None = shared.value
        for batch in pieces(batches, size=PIECE):
            found = counted(batch.column("text"))
            content = found.chars * (crf.labels(found.buckets, found.first) == CONTENT) if crf is not None else found.chars
            total, own = (np.diff(np.concatenate([[0], np.cumsum(x)])[found.first]) for x in (found.chars, content))
            share = np.where(total > 0, own / np.maximum(total, 1), 1.0)
            n_words, _, _, _, n_repeat = found.by_text.T
            failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
            yield batch, [*(pa.array(c) for c in found.by_text.T.copy()), pa.array(failed), pa.array(~failed & (share >= LEAST_CONTENT)), pa.array(share), pa.array(np.diff(found.first))]

    return run


def judge(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, the columns of keep, n_words, word_chars (code points in words), n_symbols (of
    `#*$%&|<>`), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in three-word windows that
    the text has twice or more), base_failed (fewer than LEAST_WORDS words, or more than MOST_REPEATED % of them repeated),
    kept (not base_failed, and LEAST_CONTENT of the characters in content lines), content_share (double), n_lines (with a word).

    Null and empty texts have no words and fail. Where crf is None all lines are content. Null ids stay null; repeated rows
    come out as often as they came in; columns not named, whatever their names, are ignored.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(crf)
    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long"
    return carried(docs, id_col, text_col, keep, _judged(shared), made)
