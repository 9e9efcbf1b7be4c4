"""Periodic runs of words: every maximal stretch that repeats its first words LEAST_TIMES times or more, found by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(LEAST, LEAST_TIMES * q) that no neighbouring word extends keeping period q. Words are `[^\\x20\\x09-\\x0D]+`.

Periods below SCAN are found by direct lag scans: the texts of a piece are one array, compared with itself q words on.
Periods of [W, 2W), W = SCAN, 2 * SCAN, ..., come from minimizers: the least of each W neighbouring grams of 2W words by a
hash of its words, leftmost if alike. Inside a run of such a period, some window and the window q words on lie wholly in the
run and hold the same words, so both choose the same gram; and as a gram is no shorter than q, equal grams of the run are
exactly q apart (were they closer, the run would have a smaller period). So each run has a pair of neighbours among equal
minimizers at its period, which seeds an extension to both sides over the words themselves; hashes only propose. A seed
holds its period twice, and such stretches of one scale overlap by less than two periods, so that extending each once
takes time in proportion to the text. A text of n words takes part in the scales of up to n / LEAST_TIMES words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shipping import ship
from .wordhash import carried, mix, pieces
from .wordlists import word_lists

LEAST, LEAST_TIMES = 6, 4
#: The least period that minimizers find; a power of two.
SCAN = 32
#: Bytes of text whose words are held at once (or one longer text).
PIECE = 2 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _scanned(words: np.ndarray, period: int) -> np.ndarray:
    """(start, end) of the maximal stretches with this period that are long enough, by comparing all words with those a period on."""
    same = np.zeros(max(0, len(words) - period) + 2, bool)
    same[1:-1] = words[:-period] == words[period:]
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, end = edges[::2], edges[1::2] + period
    long = end - start >= max(LEAST, LEAST_TIMES * period)
    return np.stack([start[long], end[long]], 1)


def _reach(words: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a on equal those from b on, going up (step 1) or, ending before a and b, down (step -1)."""
    total, size = 0, 64
    most = len(words) - b if step > 0 else a
    while total < most:
        size = min(size, most - total)
        x, y = (words[a + total : a + total + size], words[b + total : b + total + size]) if step > 0 else (words[a - total - size : a - total][::-1], words[b - total - size : b - total][::-1])
        unlike = x != y
        if unlike.any():
            return total + int(unlike.argmax())
        total, size = total + size, size * 2
    return total


def _minimizers(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the least gram of 2 * window words in each window of so many neighbouring grams, and those grams' hashes."""
    gram = 2 * window
    with np.errstate(over="ignore"):
        steps = np.full(len(words) + 1, 0xD6E8FEB86659FD93, np.uint64)
        steps[0] = 1
        power = np.cumprod(steps)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        # Shifted to one power of the step, so that equal grams have equal hashes wherever they stand.
        value = mix((total[gram:] - total[:-gram]) * power[::-1][gram:])
    bits = np.uint64(max(24, len(value).bit_length()))
    least = value >> bits << bits | np.arange(len(value), dtype=np.uint64)
    size = 1
    while size < window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, value[at]


def _seeded(words: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the maximal stretches with periods of [window, 2 * window) that neighbouring equal minimizers seed."""
    at, value = _minimizers(words, window)
    order = np.lexsort((at, value))
    at, value = at[order], value[order]
    lag = at[1:] - at[:-1]
    seed = np.flatnonzero((value[1:] == value[:-1]) & (lag >= window) & (lag < 2 * window))
    p, q = at[seed], lag[seed]
    order = np.lexsort((p, q))
    found, last, end = [], 0, 0
    for a, d in zip(p[order].tolist(), q[order].tolist(), strict=True):
        if d == last and a + d < end:
            continue  # inside the stretch found last
        start = a - _reach(words, a, a + d, -1)
        last, end = d, a + d + _reach(words, a, a + d, 1)
        if end - start >= max(LEAST, LEAST_TIMES * d):
            found.append((start, end, d))
    return found


def runs_of(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of some texts as rows (text, start, length, period), by text, start and period, and where each text's begin (and the end).

    words: a number for each word, alike for identical words; text d has words first[d]:first[d + 1].
    """
    n = np.diff(first)
    found = [np.zeros((0, 4), np.int64)]

    def own(least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts with so many words, their words with a number of its own after each text, and where each begins there."""
        docs = np.flatnonzero(n >= least)
        begins = np.concatenate([[0], np.cumsum(n[docs] + 1)])
        out = np.empty(begins[-1], np.int64)
        for i, d in enumerate(docs.tolist()):
            out[begins[i] : begins[i + 1] - 1] = words[first[d] : first[d + 1]]
        out[begins[1:] - 1] = -1 - np.arange(len(docs))
        return docs, out, begins

    def add(docs: np.ndarray, begins: np.ndarray, runs: np.ndarray) -> None:
        # A stretch that long crosses no end of a text: the number there would break it at two of fewer than a period's places.
        d = np.searchsorted(begins, runs[:, 0], "right") - 1
        found.append(np.stack([docs[d], runs[:, 0] - begins[d], runs[:, 1] - runs[:, 0], runs[:, 2]], 1))

    most = int(n.max(initial=0)) // LEAST_TIMES
    docs, line, begins = own(LEAST)
    for q in range(1, min(SCAN - 1, max(most, 1)) + 1):
        spans = _scanned(line, q)
        if len(spans):
            add(docs, begins, np.column_stack([spans, np.full(len(spans), q)]))
    window = SCAN
    while window <= most:
        docs, line, begins = own(LEAST_TIMES * window)
        runs = _seeded(line, window)
        if runs:
            add(docs, begins, np.array(runs, np.int64))
        window *= 2
    runs = np.concatenate(found)
    # A stretch that also has a multiple of its smallest period was found with both.
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        again = np.zeros(len(runs), bool)
        again[1:] = (runs[1:, :3] == runs[:-1, :3]).all(1)
        runs = runs[~again]
        runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return runs, np.searchsorted(runs[:, 0], np.arange(len(n) + 1))


def _longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of the greatest length / period, compared exactly; of those the first by start, then period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in pieces(batches, size=PIECE):
        _, split, words, first = word_lists(batch.column("text"))
        runs, bounds = runs_of(words, first)
        n_runs = np.diff(bounds)
        listed = pa.ListArray.from_arrays(
            pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
        )
        best, kept = [None] * len(split), []
        for d, w in enumerate(split):
            if n_runs[d]:
                own = runs[bounds[d] : bounds[d + 1]]
                best[d] = dict(zip(("start", "length", "period"), _longest([tuple(r) for r in own[:, 1:].tolist()]), strict=True))
                # Running counts of the runs that a word lies in after their first periods.
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, own[:, 1] + own[:, 3], 1)
                np.add.at(change, own[:, 1] + own[:, 2], -1)
                w = [w[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            kept.append(b" ".join(w))
        shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        yield batch, [pa.array(np.diff(first)), listed, pa.array(best, shape), pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, the columns of keep, n_words (long), runs (array of start, length, period, by start
    and then by period; words are numbered from 0), longest (the run of the greatest length / period, of those the first by
    start and then by period; null without a run), and collapsed (the words that no run contains after its first period, a
    space between).

    Null and empty texts have no words, no runs and an empty collapsed text. Null ids stay null; repeated rows come out as
    often as they came in; columns not named, whatever their names, are ignored. Texts are taken whole, a piece of PIECE
    bytes (or one longer text) at a time, so that rows are dealt as the scan deals them and nothing is shuffled.
    """
    ship(docs.sparkSession)
    one = RUNS.removeprefix("array<").removesuffix(">")
    return carried(docs, id_col, text_col, keep, _found, f"n_words long, runs {RUNS}, longest {one}, collapsed string")


def replanted(doc_id: Column, text: Column) -> Column:
    """The text with a run planted where the id asks for one; any other text as it is, a null one as empty.

    With h the crc32 of the id in decimal, g = floor(h / 10) and n words: where h % 10 = 0 and n > 0 each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null id asks for none.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Bound once each: what is named in an inner lambda would be computed again for every word.
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def planted(w: Column, n: Column, a: Column, p: Column) -> Column:
        word = lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")).otherwise("")

    words = F.filter(F.split(text, r"[ \t-\r]+", -1), lambda w: w != "")
    n = lambda v: F.size(v["w"])
    a = lambda v: F.pmod(g, F.greatest(n(v), F.lit(1)))
    p = lambda v: F.floor((n(v) - v["a"]) / (F.lit(3) + g % 8)) + 1
    whole = let(F.struct(words.alias("w")), lambda v: let(F.struct(v["w"].alias("w"), a(v).alias("a")), lambda v: let(
        F.struct(v["w"].alias("w"), n(v).alias("n"), v["a"].alias("a"), p(v).alias("p")), lambda v: planted(v["w"], v["n"], v["a"], v["p"])
    )))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), whole).otherwise(text)
