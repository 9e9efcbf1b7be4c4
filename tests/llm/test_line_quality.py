"""Line quality: counts and Viterbi against plain restatements, the verdict by held-out documents."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from vendorlake.llm import line_quality
from vendorlake.llm.queries import op11_line_quality

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def odd():
    r = random.Random(2)
    bits = ["a", "b", "Ab", "é", "😀x", "#", "$1", " ", "\n", "\n\n", "\t", "x.\n", "a b c\n", "\x0b", " ", " ", "\r\n"]
    return [None, "", " ", "\n", "a", "a\na", "a b c a b c", "\n\na \na\na ", "a b " * 40, *("".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randrange(150))) for _ in range(300))]


def test_counts_against_brute_force():
    texts = odd()
    got = line_quality.counted(pa.array(texts, pa.string())).by_text.tolist()
    assert got == [list(plain(t)[:5]) for t in texts]


def test_counts_are_alike_in_any_company():
    texts = odd()[:60]
    together = line_quality.counted(pa.array(texts, pa.string()))
    for d, t in enumerate(texts):
        alone = line_quality.counted(pa.array([t], pa.string()))
        assert (alone.by_text[0] == together.by_text[d]).all()
        assert (alone.buckets == together.buckets[together.first[d] : together.first[d + 1]]).all()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 5, 3, 0, 7, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    emission, begin, move = rng.normal(size=(first[-1], 2)), rng.normal(size=2), rng.normal(size=(2, 2))
    got = line_quality.viterbi(emission, first, begin, move)
    for a, n in zip(first[:-1], lengths, strict=True):
        if n:
            score = lambda p, a=a: begin[p[0]] + sum(emission[a + i, y] for i, y in enumerate(p)) + sum(move[x, y] for x, y in itertools.pairwise(p))
            assert tuple(got[a : a + n]) == max(itertools.product((0, 1), repeat=n), key=score)


def test_transitions_smooth_an_odd_line():
    crf = line_quality.Crf(np.zeros((line_quality._BASE[-1], 2)), np.zeros(2), np.array([[2.0, 0.0], [0.0, 2.0]]))
    emission = np.array([[0, 3], [0, 3], [1, 0], [0, 3], [5, 0], [5, 0]], float)
    assert line_quality.viterbi(emission, np.array([0, 6]), crf.begin, crf.move).tolist() == [1, 1, 1, 1, 0, 0]


def test_fit_learns_from_runs_in_any_order():
    r = random.Random(3)
    texts = ["Some words that make an ordinary line of text, as it should be.\n" * 3, "a### b$$$ c%%% d&&&\n" * 4]
    runs = [(line_quality.counted(pa.array([texts[y]])).buckets, y ^ 1) for y in (0, 1) for _ in range(20)]
    one = line_quality.fit_crf(runs, steps=40)
    r.shuffle(runs)
    two = line_quality.fit_crf(runs, steps=40)
    assert np.allclose(one.weights, two.weights) and line_quality.fit_crf([]) is None
    for t, y in zip(texts, (1, 0), strict=True):
        found = line_quality.counted(pa.array([t]))
        assert set(one.labels(found.buckets, found.first).tolist()) == {y}


def test_rows_of_the_operator(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 0), (1, text, 0), (None, text, 0), (2, None, 0), (3, "", 0), (4, "a b c " * 30, 0)]
    got = line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept int"), None).collect()
    assert len(got) == 6
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["kept"] and by_id[i]["n_words"] == 60 for i in (1, None)) and not any(by_id[i]["kept"] for i in (2, 3, 4)) and by_id[4]["base_failed"]
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    assert line_quality.fit(none, none) is None and line_quality.judge(none, None).count() == 0


def test_fit_ignores_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "x"), (2, None), (3, "y#\n\nz")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, 1, 0), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, text int")
    crf = line_quality.fit(labels, docs)
    assert crf is not None and np.isfinite(crf.weights).all()


def test_query_11(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in op11_line_quality(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        assert tuple(got[i][c] for c in COLUMNS) == plain(text), i
        assert not (got[i]["kept"] and got[i]["base_failed"])
    held_out = [i for i in quality if zlib.crc32(str(i).encode()) % 4 == 2 and not got[i]["base_failed"]]
    clean = [got[i]["kept"] for i in held_out if quality[i]]
    assert len(clean) > 5 and sum(clean) >= 0.95 * len(clean)
    assert sum(not got[i]["kept"] for i in quality if not quality[i]) >= 0.9 * sum(not q for q in quality.values())
