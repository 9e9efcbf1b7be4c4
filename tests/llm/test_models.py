"""Tokenizers against their libraries, learned models on held-out rows, nearest neighbours against brute force."""

import hashlib
import random
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vendorlake.llm import langid, merging, multi_index, toxicity
from vendorlake.llm.bpe import ByteBPE, encode_decode, ids_array
from vendorlake.llm.queries import held_out, op2_language_id, op3_bpe, op6_multi_index, op7_token_counts, op9_toxicity, tokenizer
from vendorlake.llm.token_counts import PieceCounter, token_counts

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
BYTE, PIECE = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def odd_texts():
    r = random.Random(11)
    alphabet = [chr(c) for c in (*range(0, 400), 0x0300, 0x0660, 0x2028, 0x2581, 0x3000, 0x4E00, 0xFEFF, 0x1F600, 0x200B, 0x00AD, 0x0E33, 0xAC00)] + ["the ", " ", "\n", "'s", "<|endoftext|>", "<s>", "<unk>", "▁"]
    out = ["", " ", "  ", "\n\n ", "a" * 700, "é" * 500, "the <|endoftext|> end<|endoftext|><|endoftext|>", "<|endoftext", "x  y   z ", "it's we'll I'M", "▁▁ x▁y", "\x00", "😀😀", "ab" * 400, "<s></s><0x41>"]
    return out + ["".join(r.choices(alphabet, k=r.randrange(1, 60))) for _ in range(400)]


def test_byte_bpe_is_the_library():
    t, own = tokenizers.Tokenizer.from_file(BYTE), ByteBPE(BYTE)
    for text in odd_texts():
        ids = t.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert packed == struct.pack(f"<{len(ids)}I", *ids), repr(text)
        assert own.decode(packed) == t.decode(ids, skip_special_tokens=False) == text


def test_byte_bpe_splits_every_character_like_the_library():
    t, own = tokenizers.Tokenizer.from_file(BYTE), ByteBPE(BYTE)
    for a in range(0, 0x11000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}!\n" for c in range(a, a + 64) if not 0xD800 <= c < 0xE000)
        ids = t.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids), hex(a)


def test_decoding_broken_utf8():
    t, own = tokenizers.Tokenizer.from_file(BYTE), ByteBPE(BYTE)
    r = random.Random(2)
    for _ in range(100):
        ids = [r.randrange(50257) for _ in range(12)]
        assert own.decode(struct.pack("<12I", *ids)) == t.decode(ids, skip_special_tokens=False)


def test_piece_counts_are_the_library():
    s, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), PieceCounter(PIECE)
    for text in odd_texts():
        assert own.count(text) == len(s.encode(text)), repr(text)
    whole = random.Random(1).sample(sorted(p for p in own.whole if p.startswith("▁") and not p.startswith("▁▁")), 500)
    assert all(len(s.encode(w[1:])) == 1 for w in whole if w != "▁")


def test_heap_and_scan_merge_alike():
    r = random.Random(3)
    rank = {a + b: float(r.randrange(40)) for a in ("a", "b", "ab", "ba", "aa", "aab") for b in ("a", "b", "ab", "bb", "aba")}
    for _ in range(500):
        parts = r.choices("ab", k=r.randrange(1, 40))
        assert merging._scanned(list(parts), rank, "") == merging._heaped(list(parts), rank, "")


def test_remembered_is_bounded():
    m = merging.Remembered(len, 3)
    assert [m[x] for x in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1] and len(m) <= 3


def test_frames_of_tokens(spark):
    docs = spark.createDataFrame([(1, "hello world", "x", 5), (None, None, "y", 6), (1, "hello world", "x", 5)], "doc_id long, text string, ids string, n_tokens int")
    n = len(sentencepiece.SentencePieceProcessor(model_file=PIECE).encode("hello world"))
    rows = encode_decode(docs, BYTE, keep=("ids",)).toDF("doc_id", "kept", "ids", "decoded").select("*", ids_array(F.col("ids")).alias("list")).collect()
    assert sorted((r["doc_id"] or 0, r["kept"], r["decoded"], r["list"]) for r in rows) == [(0, "y", "", []), (1, "x", "hello world", [31373, 995]), (1, "x", "hello world", [31373, 995])]
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts(docs, PIECE).collect()) == [(0, 0, 0), (1, 11, n), (1, 11, n)]


def test_queries_3_and_7(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t, s = tokenizers.Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in op3_bpe(spark, sf).collect():
        ids = t.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for r in op7_token_counts(spark, sf).collect():
        text = docs[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), len(s.encode(text)), len(s.encode(text)) > 4096)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    emission, first = rng.normal(size=(9, 3)), np.array([0, 4, 4, 5, 9])
    begin, move = rng.random(3) + 0.1, rng.random((3, 3)) + 0.1
    got = langid.posteriors(emission, first, begin, move)
    from itertools import product

    for a, b in zip(first[:-1], first[1:], strict=True):
        want = np.zeros((b - a, 3))
        for path in product(range(3), repeat=int(b - a)):
            p = 1.0
            for t, y in enumerate(path):
                p *= np.exp(emission[a + t, y]) * (begin[y] if t == 0 else move[path[t - 1], y])
            for t, y in enumerate(path):
                want[t, y] += p
        if b > a:
            np.testing.assert_allclose(got[a:b], want / want.sum(1, keepdims=True), rtol=1e-6)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100 and sum(r["lang"] == r["lang_pred"] for r in found) > 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the and of", "en"), (2, "der und das", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "en"), (6, "—", None), (None, "the and", None), (7, "— the and", None)], "doc_id long, text string, lang string")
    crf = langid.fit(docs.where("doc_id < 3"))
    got = {r["doc_id"]: r for r in langid.identify(docs, crf).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["en", "de", "und", "und", "und", "und", "en", "en"]
    none = langid.identify(docs, langid.fit(docs.where("false"))).collect()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in none)
    assert langid.identify(docs.where("false"), crf).count() == 0


def test_language_of_long_and_repeated_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.where("lang in ('de', 'fr') and n_chars > 300").orderBy("doc_id").collect()}
    crf = langid.fit(docs)
    rows = [(1, texts["de"] * 600, "x", 1), (2, texts["fr"], "y", 2), (2, texts["fr"], "y", 2), (3, texts["fr"] * 600, "z", 3)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, score string, lang_pred int"), crf, keep=("score", "lang_pred")).toDF("doc_id", "kept", "kept2", "lang", "score", "n_words", "n_switches")
    got = sorted((r["doc_id"], r["kept"], r["lang"]) for r in found.collect())
    assert got == [(1, "x", "de"), (2, "y", "fr"), (2, "y", "fr"), (3, "z", "fr")]
    again = langid.fit(docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id < 50")))
    assert np.array_equal(again.weights, crf.weights) and again.langs == crf.langs


def test_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = langid.fit(docs.where(~held_out()))
    two = {r["lang"]: r["text"] for r in docs.where(held_out() & F.col("lang").isin("en", "fr")).where("n_chars > 300").orderBy("doc_id").collect()}
    mixed = " ".join(two["en"].split()[:40] + two["fr"].split()[:40])
    first, _, p = crf.label(pa.array([mixed]))
    best = [crf.langs[k] for k in p.argmax(1)]
    assert first.tolist() == [0, len(best)] and best[:35].count("en") > 25 and best[-35:].count("fr") > 25


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    # Labels carry noise: some marked documents have no toxic word, so no score can find them.
    assert sum(x >= 0.3 for x in toxic) > 0.8 * len(toxic) and sum(x >= 0.3 for x in clean) < 0.03 * len(clean)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_by_hand(spark):
    r = random.Random(1)
    word = lambda: r.choice(["river", "stone", "bread", "light", "garden", "paper", "window"])
    text = lambda bad: " ".join(word() for _ in range(30)) + (" vile scum " if bad else " ") + " ".join(word() for _ in range(30))
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = toxicity.fit(docs.selectExpr("doc_id", "score as toxic"), docs)
    new = spark.createDataFrame([(1, text(True)), (2, text(False)), (3, None), (4, ""), (None, "scum")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert got[1] > 0.8 and got[2] < 0.2 and all(0 <= x <= 1 for x in got.values())
    empty = toxicity.fit(docs.where("false").selectExpr("doc_id", "score as toxic"), docs)
    assert all(0 <= r["score"] <= 0.3 for r in toxicity.score(new, empty).collect())
    assert toxicity.score(new.where("false"), model).count() == 0


def test_rare_toxic_words_count(spark):
    r = random.Random(6)
    plain = lambda n: " ".join(r.choice(["river", "stone", "bread", "light", "garden", "paper", "window"]) for _ in range(n))
    bad = lambda i: f"{'aeiou'[i % 5]}z{'bdgklm'[i % 6]}{'aeiou'[i % 7 % 5]}x" if i % 4 == 0 else f"mild{i % 7} calm" if i % 4 == 1 else plain(2)
    n = lambda: r.randrange(20, 40)
    docs = spark.createDataFrame([(i, f"{plain(n())} {bad(i)} {plain(n())}", int(i % 4 == 0)) for i in range(300)], "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs)
    head, tail = plain(30), plain(31)
    new = spark.createDataFrame([(1, f"{head} {bad(16)} {tail}"), (2, f"{head} calm {tail}"), (3, f"{head} mild3 {tail}")], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(new, model).collect()}
    assert got[1] > 0.5 and got[2] < 0.3 and got[3] < 0.3


def spaced_words(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    return b"".join(w.lower() + b" " for w in words)


class PlainKneserNey:
    def __init__(self, texts, order=5, d=0.75):
        self.order, self.d, self.n = order, d, ({}, {})
        for text, c in texts:
            s = b" " * (order - 1) + spaced_words(text)
            for i in range(order - 1, len(s)):
                g = s[i - order + 1 : i + 1]
                self.n[c][g] = self.n[c].get(g, 0) + 1
        self.types = {order: set(self.n[0]) | set(self.n[1])}
        for k in range(order - 1, 0, -1):
            self.types[k] = {g[1:] for g in self.types[k + 1]}

    def q(self, x, h):
        if h is None:
            return 1 / 256
        k = len(h) + 1
        c = {}
        for g in self.types[k + 1]:
            if g[1:-1] == h:
                c[g[-1:]] = c.get(g[-1:], 0) + 1
        lower = self.q(x, h[1:] if h else None)
        return lower if not c else (max(c.get(x, 0) - self.d, 0) + self.d * len(c) * lower) / sum(c.values())

    def p(self, c, x, h):
        own = {g[-1:]: n for g, n in self.n[c].items() if g[:-1] == h}
        q = self.q(x, h[1:])
        return q if not own else (max(own.get(x, 0) - self.d, 0) + sum(min(n, self.d) for n in own.values()) * q) / sum(own.values())


def test_kneser_ney_against_brute_force(spark):
    texts = [("The vile scum", 1), ("vile é", 1), ("the river, the stone", 0), ("A viler river", 0), ("stone stone", 0)]
    plain = PlainKneserNey(texts)
    every = [bytes([b]) for b in range(256)]
    for h in (b"    ", b" the", b"vile", b"scum", b"xyzw"):
        for c in (0, 1):
            assert abs(sum(plain.p(c, x, h) for x in every) - 1) < 1e-9
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(texts)], "doc_id long, text string, toxic int")
    counts = toxicity.fit(docs, docs).held.value
    # What neither class has counts for neither.
    log = lambda m, g: np.log(m.p(1, g[-1:], g[:-1]) / m.p(0, g[-1:], g[:-1])) if g in m.n[0] or g in m.n[1] else 0.0
    new = "the viler scum of stone qq"
    s = b"    " + spaced_words(new)
    g, bounds, first = toxicity._grams(pa.array([new]))
    assert len(g) == len(s) - 4 and len(bounds) == 7 and first.tolist() == [0, 6]
    np.testing.assert_allclose(counts.ratios(g), [log(plain, s[i - 4 : i + 1]) for i in range(4, len(s))], rtol=1e-4, atol=1e-5)
    # A counted text by the counts of all others: its own n-grams go, the backoff stays.
    for k in (0, 3):
        text, c = texts[k]
        others = PlainKneserNey([x for i, x in enumerate(texts) if i != k])
        others.types = plain.types
        s = b"    " + spaced_words(text)
        np.testing.assert_allclose(counts.ratios(toxicity._grams(pa.array([text]))[0], c), [log(others, s[i - 4 : i + 1]) for i in range(4, len(s))], rtol=1e-4, atol=1e-5)


def test_scores_by_broadcast_and_by_shuffle_are_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"), F.lit(1).alias("block"))
    long = " ".join(r["text"] for r in docs.limit(60).collect() if r["text"]) * 3
    docs = docs.unionByName(spark.createDataFrame([(None, "x", "", 1), (7, None, "", 1), (7, None, "", 1), (8, long, "", 1)], docs.schema))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = [sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in toxicity.score(docs, toxicity.fit(labels, docs, broadcast_rows=n)).collect()) for n in (0, 10**6)]
    assert found[0] == found[1] and len(found[0]) == docs.count()


def brute_nearest(vectors, queries, k):
    ids = np.array([i for i, _ in vectors])
    m = np.array([v for _, v in vectors], float)
    out = {}
    for q, v in queries:
        s = m @ np.array(v, float)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_search_probing_all_is_exact(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(300)]
    good += [(300 + i, good[0][1]) for i in range(30)]  # ties
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 3), (904, [None] * 8), (905, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in multi_index.search(df, df.where("vec_id % 20 = 0 or vec_id > 899"), k=20, probe=1.0, queries_a_block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(good, [x for x in good if x[0] % 20 == 0], 20)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found]
        np.testing.assert_allclose([s for _, s in got[q]], [s for _, s in found], rtol=1e-12)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in multi_index.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 4.0)]
    assert multi_index.search(df.where("false"), df).count() == 0 and multi_index.search(df, df.where("false")).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(vectors, [x for x in vectors if x[0] % 20 == 0], 20)
    got = {}
    for r in op6_multi_index(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in found}) / 20 for q, found in want.items()]) >= 0.9


@pytest.mark.parametrize("n", [3000, 12000])
def test_recall_of_larger_indexes(spark, n):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10, 32))[rng.integers(0, 10, n)] + rng.normal(size=(n, 32)) / 2
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": [v.tolist() for v in x]}))
    got = {}
    for r in multi_index.search(df, df.where("vec_id % 20 = 0"), k=20, queries_a_block=200).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scores = x[::20] @ x.T
    scores[np.arange(len(scores)), np.arange(0, n, 20)] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :20]
    assert np.mean([len(got[20 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)]) >= 0.9


def test_nearest_breaks_ties_by_id():
    scores = np.array([[1.0, 3, 3, 3, -np.inf], [-np.inf] * 5, [5, 4, 3, 2, 1]])
    row, column = multi_index.nearest(np.array([9, 8, 7, 6, 5]), scores, 2)
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == [(0, 3), (0, 2), (2, 0), (2, 1)]


def test_centroids_grow_with_the_vectors():
    assert [multi_index.centroids_for(n) for n in (0, 5000, 51_282, 10**6, 10**9)] == [16, 16, 64, 128, 128]


def test_walk_is_in_order():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=6), rng.normal(size=5)
    cells = multi_index.cells_by_score(a, b, np.ones(30, int), 30)
    scores = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and all(x >= y - 1e-12 for x, y in zip(scores, scores[1:], strict=False))
