"""Near duplicates, decontamination and repeated spans against brute force."""

import random

import numpy as np
import pytest
from brute import groups

from vendorlake.llm import chunk_dedup, decontaminate, jaccard_join
from vendorlake.llm.components import components
from vendorlake.llm.jaccard_join import Bands, similar_groups
from vendorlake.llm.queries import op1_decontaminate, op4_ngram_jaccard_join, op5_substring_dedup

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, component_id string, numbers int"


def family(r, n, size, most):
    base = [r.choice(WORDS) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        own = list(base)
        for _ in range(r.randrange(most + 1)):
            own[r.randrange(len(own))] = r.choice(WORDS)
        out.append(" ".join(own))
    return out


def texts(seed):
    r = random.Random(seed)
    out = [None, "", " \t\n", "one", "one", "One two", "one two three", "é", "a b c d", "a b c d e", "a b c d f"]
    for size in (4, 6, 8, 9, 10, 12, 16, 20, 25, 30, 45, 60, 100, 150, 300, 900):
        out += family(r, 8, size, max(1, size // 12))
    out += family(r, 60, 120, 8) + ["same text of seven words right here"] * 5
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("width", "part"), [(4, 85), (3, 60)])
def test_groups(spark, width, part):
    rows = list(enumerate(texts(width), 1))
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_groups(docs, width=width, part=part).collect()}
    assert got == groups(rows, width, part, 100)


@pytest.mark.parametrize("part", [60, 80, 85, 95])
def test_linked_sets_share_a_signature(part):
    import numpy as np

    rng, bands = np.random.default_rng(part), Bands(part, 100)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        most = (100 - part) * len(a) // part
        added, gone = int(rng.integers(0, most + 1)), 0
        while 100 * (len(a) - gone - 1) >= part * (len(a) + added):
            gone += 1
        gone = int(rng.integers(0, gone + 1)) if len(a) > 1 else 0
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]], rng.integers(0, 1 << 62, added).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if 100 * same >= part * (len(a) + len(b) - same):
            with np.errstate(over="ignore"):
                assert len(np.intersect1d(bands.signatures(a), bands.signatures(b))), (len(a), len(b), same)


def pages(n, seed=1, own=300, header=30, footer=30):
    """Pages with one header, one of two footers, and words of their own: none linked to another."""
    r = random.Random(seed)
    some = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    top, bottom = some(header), (some(footer), some(footer))
    return [(i, f"{top} {some(own)} {bottom[i % 2]}") for i in range(1, n + 1)]


def candidates(spark, rows, monkeypatch, width=5, part=80):
    """The candidate pairs that are compared, in both steps, and the result."""
    seen, verified = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *rest: (seen.append(pairs.count()), verified(pairs, *rest))[1])
    groups_ = {r["doc_id"]: r["component_id"] for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=width, part=part).collect()}
    return sum(seen), groups_


def test_stock_passages_make_no_square_of_candidates(spark, monkeypatch):
    few, found = candidates(spark, pages(500), monkeypatch)
    assert all(i == c for i, c in found.items())
    many, found = candidates(spark, pages(2000), monkeypatch)
    assert all(i == c for i, c in found.items()) and many < 2000 and few < 500


def test_links_among_pages_with_stock_passages(spark):
    r = random.Random(8)
    rows = pages(120, 2, own=60) + [(1000 + i, t) for i, t in pages(120, 3, own=25, header=60, footer=60)]
    for i, t in list(rows)[::5]:
        words = t.split()
        for _ in range(r.randrange(1, 6)):
            words[r.randrange(len(words))] = "edited"
        rows.append((5000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, part in ((5, 80), (4, 85)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_groups(docs, width=width, part=part).collect()}
        assert got == groups(rows, width, part, 100)


def test_groups_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in similar_groups(docs).collect())
    assert got == [(0, None), (7, 7), (7, 7), (9, 7)]
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_query_4(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_ngram_jaccard_join(spark, sf).collect()}
    assert got == groups(rows, 4, 85, 100)


def contaminated_by_brute_force(docs, items):
    out = {}
    for d, t in docs:
        own = decontaminate.exact_shingles(t, 5)
        for i, x in items:
            q = decontaminate.exact_shingles(x, 5)
            if q and 100 * len(q & own) >= 80 * len(q):
                out[d, i] = (len(q), len(q & own))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination(spark, limit):
    r = random.Random(3)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(n))) for i, n in enumerate((1, 3, 5, 6, 9, 15, 30, 60))] + [(90, None), (91, ""), (92, "...")]
    docs = [(1, None), (2, ""), (3, items[0][1])]
    for k in range(60):
        _, item = items[r.randrange(8)]
        words = item.split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        fill = lambda: " ".join(r.choice(WORDS) for _ in range(r.choice((0, 5, 3000))))
        docs.append((10 + k, f"{fill()} {', '.join(words).upper()} {fill()}"))
    d = spark.createDataFrame([(*x, 1, "") for x in docs], "doc_id long, text string, item_id int, n_shared string")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in decontaminate.contaminated(d, b, broadcast_bytes=limit).collect()}
    assert got == contaminated_by_brute_force(docs, items) and len(got) > 20


def test_decontamination_by_shuffle_with_a_common_phrase(spark, monkeypatch):
    """Every document holds the phrase that most items hold too, and more items than are held against a text at a time."""
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    r = random.Random(8)
    fresh = lambda n: " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(n))
    phrase = fresh(8)
    items = [(i, f"{phrase} {fresh(r.choice((0, 1, 2, 12)))}".strip()) for i in range(40)] + [(50, fresh(30)), (50, fresh(30))]
    docs = [(i, f"{fresh(20)} {r.choice(items)[1]} {phrase} {fresh(20)}") for i in range(120)] + [(7, "other " + phrase), (None, phrase), (None, phrase)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(d, b, broadcast_bytes=0).collect()
    held = contaminated_by_brute_force([(k, t) for k, (_, t) in enumerate(docs)], items[:40])
    got = {(x["doc_id"], x["item_id"]) for x in rows}
    assert len(got) == len(rows) > 500 and {x for x in got if x[1] < 40} == {(docs[k][0], i) for k, i in held}
    same = {tuple(x) for x in decontaminate.contaminated(d, b).collect()}
    assert {tuple(x) for x in rows} == same


def test_bits_name_every_hash_of_a_sketch(spark):
    r = np.random.default_rng(2)
    h = r.integers(-(2**63), 2**63, 5000, dtype=np.int64)
    shared = decontaminate._bits(spark.createDataFrame([(x,) for x in h.tolist()], "h long"))
    assert decontaminate._hit(shared.value, h.view(np.uint64)).all()
    assert decontaminate._hit(shared.value, r.integers(0, 2**63, 100_000, dtype=np.uint64)).mean() < 0.001


def test_decontamination_of_nothing(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(d, b).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([(1, "x")], "doc_id long, text string"), b).count() == 0


def test_query_1(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in op1_decontaminate(spark, sf).collect()}
    assert got == contaminated_by_brute_force(docs, items)


def plain_boundaries(data):
    h, mask, all_h = 0, (1 << 32) - 1, []
    for b in data:
        h = ((h << 2) + int(chunk_dedup.GEAR[b])) & mask
        all_h.append(h)
    reach, n, ends, last = chunk_dedup.REACH, len(data), [], 0
    near = -1 - reach
    for i in range(n):
        least = reach <= i < n - reach - 1 and all_h[i] <= min(all_h[i - reach : i]) and all_h[i] <= min(all_h[i + 1 : i + reach + 1])
        if i == n - 1 or (least and (i + 1 - near > reach)):
            near = i + 1
            ends += list(range(last + chunk_dedup.LONGEST, i + 1, chunk_dedup.LONGEST)) + [i + 1]
            last = i + 1
    return ends


@pytest.mark.parametrize("text", ["", "a", "ab" * 10, "x" * 5000, "The " * 300 + "end of it " + "xy" * 40, " ".join(random.Random(1).choices(WORDS, k=900)), "é" * 300 + "the end"])
def test_boundaries(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    assert chunk_dedup.boundaries(data).tolist() == plain_boundaries(data)


def test_chunks_cover_texts_and_resist_shifts(spark):
    text = " ".join(random.Random(2).choices(WORDS, k=600))
    rows = chunk_dedup.spread(chunk_dedup.chunks(spark.createDataFrame([(1, text), (2, "inserted " + text), (3, None), (4, "")], "doc_id long, text string"))).collect()
    by = {i: sorted((r["start"], r["stop"], r["words"], r["digest"]) for r in rows if r["id"] == i) for i in (1, 2, 3, 4)}
    assert not by[3] and not by[4]
    assert by[1][0][0] == 0 and by[1][-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(by[1], by[1][1:], strict=False)) and sum(c[2] for c in by[1]) == 600
    same = {c[3] for c in by[1]} & {c[3] for c in by[2]}
    assert len(same) > 0.9 * len(by[1])


def test_repeated_passages_are_found_and_others_left(spark):
    r = random.Random(4)
    fresh = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))
    passages = [fresh(55) for _ in range(30)]
    docs, held = [], {}
    for i in range(30):
        for side in (0, 1):
            d = 2 * i + side + 1
            before = fresh(r.randrange(200)) + " "
            docs.append((d, before + passages[i] + " " + fresh(r.randrange(200))))
            held[d] = (len(before), len(before) + len(passages[i]), 2 * i + 1)
    docs += [(1000 + i, fresh(300) + " a line of ten words or so that is common here " + fresh(100)) for i in range(20)]
    got = {r["doc_id"]: r for r in chunk_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == set(held)
    for d, (start, stop, first) in held.items():
        (a, b), *more = (map(int, s.split(":")) for s in got[d]["spans"].split(","))
        assert not more and start - 1 <= a < b <= stop + 1 and got[d]["first_id"] == first
        assert got[d]["n_bytes"] == b - a and got[d]["n_spans"] == 1


def test_passages_of_short_words_are_found(spark):
    """Of passages of 51 words with 1 to 3 letters between fresh texts, 0.99 at least have a span in both documents."""
    r = random.Random(6)
    fresh = lambda n, longest: " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(1, longest))) for _ in range(n))
    passages = [fresh(51, 3) for _ in range(300)]
    docs = [(2 * i + side, f"{fresh(40, 8)} {p} {fresh(40, 8)}") for i, p in enumerate(passages) for side in (0, 1)]
    docs += [(1000 + i, fresh(120, 3)) for i in range(100)]
    got = {x["doc_id"] for x in chunk_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert max(got) < 1000 and sum({2 * i, 2 * i + 1} <= got for i in range(300)) >= 0.99 * 300


def test_documents_with_spans_are_those_that_brute_force_finds(spark, sf):
    """Every document with a run of 30 words that stands in another one has a span, and every one with a span a run of 20 words."""
    docs = [(x["doc_id"], (x["text"] or "").split()) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def repeating(n):
        owners = {}
        for i, w in docs:
            for k in range(len(w) - n + 1):
                owners.setdefault(tuple(w[k : k + n]), set()).add(i)
        return {i for held in owners.values() if len(held) > 1 for i in held}

    got = {x["doc_id"] for x in op5_substring_dedup(spark, sf).collect()}
    assert repeating(30) <= got <= repeating(20)


def test_deduplicated_texts_keep_the_first_copy(spark):
    r = random.Random(14)
    fresh = lambda n: " ".join("".join(r.choices("abcdéfghij", k=r.randrange(2, 9))) for _ in range(n))
    passage, rows = fresh(120), [(9, None), (None, "é x"), (None, "é x")]
    rows += [(i, f"{fresh(60)} {passage} {fresh(60)}") for i in (1, 2, 3)]
    docs = spark.createDataFrame([(*x, "") for x in rows], "doc_id long, text string, kept_text string")
    got = {x["doc_id"]: x["kept_text"] for x in chunk_dedup.deduplicated(docs).collect()}
    assert got[1] == rows[3][1] and got[9] == "" and got[None] == "é x" and chunk_dedup.deduplicated(docs).count() == len(rows)
    for i in (2, 3):
        text = rows[2 + i][1]
        head, tail = text.split(passage)
        assert got[i].startswith(head) and got[i].endswith(tail) and len(got[i]) < len(text) - 0.7 * len(passage)
    spans = {x["doc_id"]: x["keepers"] for x in chunk_dedup.repeated_spans(docs).collect()}
    assert spans == {1: "1", 2: "1", 3: "1"}


def test_query_5_spans_repeat(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_substring_dedup(spark, sf).collect()
    assert rows
    for r in rows:
        a, b = map(int, r["spans"].split(",")[0].split(":"))
        first = docs[r["doc_id"]][a : min(b, a + 60)]
        assert any(first in t for i, t in docs.items() if i != r["doc_id"])
        for a, b in (map(int, x.split(":")) for x in r["spans"].split(",")):  # no part of any span is in this document alone
            for at in range(a, b - 30, 16):
                assert any(docs[r["doc_id"]][at : at + 30] in t for i, t in docs.items() if i != r["doc_id"])


def test_repeated_spans_of_odd_rows(spark):
    assert chunk_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(random.Random(9).choices(WORDS, k=200))
    docs = spark.createDataFrame([(None, long, "x"), (1, long, "x"), (1, long, "x"), (2, "short", "x")], "doc_id long, text string, spans string")
    assert chunk_dedup.repeated_spans(docs).count() == 0


def test_spans_of_a_repeated_row_with_a_partner(spark):
    long, other = (" ".join(random.Random(k).choices(WORDS, k=200)) for k in (9, 10))
    find = lambda rows: {r["doc_id"]: (r["n_spans"], r["n_words"], r["spans"]) for r in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    once = find([(1, long), (2, long)])
    assert set(once) == {1, 2} and find([(1, long), (1, long), (2, long)]) == once
    both = find([(1, long), (1, other), (2, long), (3, other)])
    assert set(both) == {1, 2, 3} and both[1][0] == both[2][0] + both[3][0] and both[1][1] == both[2][1] + both[3][1]


def test_hot_digest_is_dealt_into_parts_and_keeps_every_row(spark):
    rows = [(i, 7, i) for i in range(6000)] + [(i, 100 + i // 2, 0) for i in range(3000)] + [(1, 5, 3), (1, 5, 9)]
    df = spark.createDataFrame(rows, "id long, digest long, place long")
    got = chunk_dedup._in_two(df, ["digest"]).collect()
    ids = {}
    for i, d, _ in rows:
        ids.setdefault(d, set()).add(i)
    assert sorted((r["id"], r["digest"], r["place"], r["first_id"]) for r in got) == sorted((i, d, p, min(ids[d])) for i, d, p in rows if len(ids[d]) > 1)
    per_part = {}
    for r in got:
        if r["digest"] == 7:
            per_part[r["salt"]] = per_part.get(r["salt"], 0) + 1
    assert len(per_part) > 1000 and max(per_part.values()) < 30
    assert not chunk_dedup._in_two(df.limit(0), ["digest"]).collect()
