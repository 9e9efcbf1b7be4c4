"""Periodic runs, against a plain restatement."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from vendorlake.llm import periodic
from vendorlake.llm.queries import op12_periodic_runs

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def plain_row(doc_id, text):
    words = SPACED.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def listed(texts):
    """runs_of() over several texts (lists of numbers) at once, as a list for each."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    runs, bounds = periodic.runs_of(np.array([x for t in texts for x in t], np.int64), first)
    return [[tuple(r) for r in runs[bounds[d] : bounds[d + 1], 1:].tolist()] for d in range(len(texts))]


def made(r, n, letters, longest):
    """Random words with stretches of random periods in them, some with a word changed."""
    out = []
    while len(out) < n:
        kind = r.random()
        if kind < 0.4:
            out += [r.randrange(letters) for _ in range(r.randrange(1, 20))]
        else:
            q = r.randrange(1, longest + 1)
            unit = [r.randrange(letters) for _ in range(q)] if kind < 0.8 else ([r.randrange(letters) for _ in range(max(1, q // 3))] * 3)[:q]
            part = (unit * 12)[: r.randrange(3 * q, 9 * q + 1)]
            if r.random() < 0.2:
                part[r.randrange(len(part))] = letters
            out += part
    return out[:n]


@pytest.mark.parametrize("scan", [2, 4, 32])
def test_runs_against_brute_force(monkeypatch, scan):
    monkeypatch.setattr(periodic, "SCAN", scan)
    r = random.Random(scan)
    texts = [[], [1], [1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, [1, 2] * 50, [1, 2, 3, 1, 2] * 30, [7] * 900]
    texts += [made(r, r.randrange(1, 400), r.choice((1, 2, 3, 50)), r.choice((3, 20, 60))) for _ in range(150)]
    texts += [made(r, 1500, r.choice((2, 9)), 150) for _ in range(6)]
    assert listed(texts) == [plain_runs(t) for t in texts]
    assert any(q >= 32 for t in listed(texts) for *_, q in t)


def test_runs_of_runs_and_fibonacci_words():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    nested = ([1, 2] * 6 + [3]) * 8 + [4]
    texts = [fib[-1][:1500], nested * 5, [5] + nested * 5, nested * 5 + nested[:30]]
    assert listed(texts) == [plain_runs(t) for t in texts]


def test_long_texts_take_time_in_proportion():
    import time

    r = np.random.default_rng(3)
    seconds = []
    for n in (200_000, 800_000):
        # Random words, one word over and over, a passage of 30,000 words five times, and two words in turn.
        words = np.concatenate([r.integers(0, 1 << 40, n // 4), np.full(n // 4, 7), np.tile(r.integers(0, 1 << 40, n // 20), 5), np.tile([1, 2], n // 8)])
        began = time.perf_counter()
        runs, _ = periodic.runs_of(words, np.array([0, len(words)]))
        seconds.append(time.perf_counter() - began)
        # What follows the passage begins with neither of its words; the two others stand next to it.
        assert [tuple(x) for x in runs[:, 1:].tolist()] == [(n // 4, n // 4, 1), (n // 2, n // 4, n // 20), (3 * n // 4, n // 4, 2)]
    assert seconds[1] < 30


def test_rows_of_the_operator(spark):
    text = "start " + "a b c " * 5 + "end"
    rows = [(1, text, 9), (1, text, 9), (None, text, 9), (2, None, 9), (3, "", 9), (4, " \n\t ", 9), (5, "é é é é é é", 9)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    assert len(got) == 7
    by_id = {r["doc_id"]: r for r in got}
    for i in (1, None):
        assert [tuple(x) for x in by_id[i]["runs"]] == [(1, 15, 3)] and by_id[i]["collapsed"] == "start a b c end" and by_id[i]["n_words"] == 17
        assert tuple(by_id[i]["longest"]) == (1, 15, 3)
    for i in (2, 3, 4):
        assert (by_id[i]["n_words"], by_id[i]["runs"], by_id[i]["longest"], by_id[i]["collapsed"]) == (0, [], None, "")
    assert [tuple(x) for x in by_id[5]["runs"]] == [(0, 6, 1)] and by_id[5]["collapsed"] == "é"


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(none).count() == 0


def test_query_12(spark, sf, tmp_path):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op12_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    planted = 0
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for i, text in docs.items():
        if len(text or "") < 20_000:
            assert tuple(got[i][c] for c in columns) == plain_row(i, text), i
            planted += zlib.crc32(str(i).encode()) % 10 == 0
    assert planted > 5


def test_query_12_odd_texts(spark, tmp_path):
    r = random.Random(4)
    texts = [None, "", " ", " x  y\u0085z", *(" ".join(map(str, made(r, r.randrange(1, 300), 3, 40))) for _ in range(120))]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = sorted(tuple(x[c] for c in columns) for x in op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == [plain_row(i, t) for i, t in rows]
