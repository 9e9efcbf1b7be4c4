"""The prefix trie: against a plain restatement, at several heights of bands and blocks."""

import hashlib
import random
import zlib

import pytest

from vendorlake.llm import prefix_trie
from vendorlake.llm.queries import op13_prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows, graft):
    """rows: (conv_id, turn, role, text) -> the nodes, sorted."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = own
    if graft:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        convs = {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[q] for q in children.get(p, [])]
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        totals[p] = (sum(b[0] for b in below) or 1, own_saved + sum(b[1] for b in below))
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(seed):
    """Conversations that share beginnings, some long, some equal; with null turns, roles and texts, and repeated rows and turns."""
    r = random.Random(seed)
    rows, texts = [], ["", None, "hé", "😀😀", "a longer text", "x"]
    for c in [*range(0, 40), *range(100, 130), 200, 305, 306, 1_000_000_007]:
        shared = [("user", f"{k % 3}") for k in range(r.choice((0, 2, 9, 30)))]
        own = [(r.choice(["user", "assistant", None]), r.choice(texts)) for _ in range(r.choice((1, 1, 3, 12)))]
        rows += [(c, t, *x) for t, x in enumerate(shared + own)]
    rows += [(5, None, "user", "early"), (5, None, None, "early"), (7, 0, "a", "tie"), (7, 0, "a", "tie"), (7, 0, "a", "sie"), (None, 0, "user", "nobody's")]
    r.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, depth int")


@pytest.mark.parametrize(("band", "block", "graft"), [(8, 4096, True), (2, 8, False), (3, 9, True)])
def test_nodes_against_brute_force(spark, monkeypatch, band, block, graft):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = made(band)
    turns = prefix_trie.ordered(table(spark, rows))
    assert rows_of(prefix_trie.rollup((prefix_trie.grafted if graft else prefix_trie.beginnings)(turns))) == plain(rows, graft)


def test_texts_of_one_turn_are_ordered_when_all_are_shuffled_too(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", -1)
    rows = made(9)
    assert rows_of(prefix_trie.rollup(prefix_trie.beginnings(prefix_trie.ordered(table(spark, rows))))) == plain(rows, False)


def test_a_conversation_that_holds_most_rows_is_dealt_over_tasks(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(5)]
    turns = prefix_trie.ordered(table(spark, rows).repartition(4))
    got = sorted((r["conv_id"], r["rank"]) for r in turns.collect())
    assert got == [(1, t) for t in range(3000)] + [(2, 3000 + t) for t in range(5)]
    assert rows_of(prefix_trie.rollup(prefix_trie.beginnings(turns))) == plain(rows, False)


def test_no_conversation_has_no_node(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.rollup(prefix_trie.grafted(prefix_trie.ordered(table(spark, rows)))).count() == 0


def test_query_13(spark, sf):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert rows_of(op13_prefix_trie(spark, sf)) == plain(rows, True)
