"""The trie of conversations' beginnings, with totals over subtrees by a depth-band rollup.

A node is a distinct sequence of first turns (role, text); it is named by its depth and 128 bits, the exclusive or of its
turns' hashes, each taken with its place. So names are running sums, which a conversation of any length gets in runs of
BLOCK turns, and a node's parent is its name without its last turn.

Totals: the trie is cut into bands of BAND depths. Each node adds its own figures to its ancestors within its band only (at
most BAND rows). The topmost nodes of the bands form a trie of a BAND-th of the depth, whose totals come the same way; each
completed total of a band's top is then added to the ancestors of that top within the band above. So there are as many
rounds as max_depth has digits to the base BAND, and a node is never multiplied by its depth.

Turns are put into order by one range partitioning of all turns, so that a conversation that holds a third of them is
dealt over many tasks; their texts are shuffled only where a conversation has several rows of one turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import discard, written
from .shipping import ship

BAND = 8
#: Turns of a conversation whose running names are one task's, a power of BAND; conversations whose ids are hashed as one text are as many at most.
BLOCK = BAND**4
HEAD, SHARED = 6, 100
#: Turns that stand several times in their conversation, up to so many, go to every executor; beyond, all texts are shuffled.
BROADCAST_ROWS = 1_000_000
NODE = ["depth", "x", "y"]
_PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition, then 33 bits for the row within it


def ordered(conversations: DataFrame) -> DataFrame:
    """The turns in one order: conv_id, rank (from 0 over all turns, by conversation, turn, role and text, nulls first), a, b (128 bits of role and text), chars (code points of text).

    A null role or text counts as empty; turns of a null conversation are left out. Repeated rows are turns as often as they
    stand, and several rows of one turn follow each other by role and text. Other columns, whatever their names, are ignored.
    """
    spark = conversations.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.where("conv_id is not null").select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    ties = t.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("tied"))
    ties = written(ties, "ties")
    n_ties = ties.count()
    t = t.withColumn("text_hash", F.xxhash64("role", "text")).withColumn("other_hash", F.xxhash64("text", F.lit(1), "role"))
    shown = F.col("text")
    if n_ties <= BROADCAST_ROWS:
        t = t.join(F.broadcast(ties), (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
        shown = F.when(F.col("tied"), F.col("text"))
    t = t.select("conv_id", "turn", "role", shown.alias("shown"), "row", F.col("text_hash").alias("a"), F.col("other_hash").alias("b"), F.length("text").cast("long").alias("chars"))
    # The row's own number comes last, so that even equal rows can be dealt over tasks.
    order = ["conv_id", "turn", "role", "shown", "row"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), "a", "b", "chars")
    t = written(t, "ordered")
    discard(ties)
    part = F.shiftrightunsigned("at", 33)
    # One row a partition.
    sizes = sorted((r["part"], r["n"]) for r in t.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins, total = [], 0
    for p, n in sizes:
        begins.append((p, total))
        total += n
    begins = spark.createDataFrame(begins, "part long, begin long")
    t = t.withColumn("part", part).join(F.broadcast(begins), "part")
    return t.select("conv_id", (F.col("begin") + F.col("at").bitwiseAND(_PLACE)).alias("rank"), "a", "b", "chars")


def _with_roots(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns and, for each conversation, its empty beginning."""
    zero = F.lit(0).cast("long")
    return turns.unionByName(convs.select("conv_id", "first", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("chars")))


def _conversations(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.min("rank").alias("first"))


def beginnings(turns: DataFrame) -> DataFrame:
    """ordered() turns as rollup() takes them: conv_id, first (rises with conv_id, by one at least), depth (from 1; 0 for the empty beginning), a, b, chars."""
    convs = _conversations(turns)
    own = turns.join(convs, "conv_id").select("conv_id", "first", (F.col("rank") - F.col("first") + 1).alias("depth"), "a", "b", "chars")
    return _with_roots(own, convs)


def grafted(turns: DataFrame) -> DataFrame:
    """beginnings() of rebuilt conversations: c has the first h turns of conversation c - c % SHARED (all if fewer, none if
    there is none), then its own after its first h, where h is the crc32 of c in decimal modulo HEAD."""
    convs = _conversations(turns)
    shared = F.col("conv_id") - F.col("conv_id") % SHARED
    h = F.crc32(F.col("conv_id").cast("string")) % HEAD
    is_shared = F.col("conv_id") % SHARED == 0
    heads = turns.where(is_shared).join(convs.where(is_shared), "conv_id").withColumn("at", F.col("rank") - F.col("first")).where(F.col("at") < HEAD - 1)
    # At most HEAD - 1 turns a conversation, and at most SHARED conversations share them.
    heads = heads.groupBy(F.col("conv_id").alias("shared")).agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "chars"))).alias("heads"))
    convs = convs.withColumns({"shared": shared, "h": h}).join(heads, "shared", "left").withColumn("heads", F.filter("heads", lambda t: t["at"] < F.col("h")))
    convs = written(convs.select("conv_id", "first", "h", F.coalesce("heads", F.expr("array()").cast("array<struct<at:bigint,a:bigint,b:bigint,chars:bigint>>")).alias("heads")), "convs")
    place = F.col("rank") - F.col("first") - F.col("h")
    own = turns.join(convs.select("conv_id", "first", "h", F.size("heads").alias("n")), "conv_id").where(place >= 0)
    own = own.select("conv_id", "first", (F.col("n") + place + 1).cast("long").alias("depth"), "a", "b", "chars")
    head = convs.select("conv_id", "first", F.explode("heads").alias("t")).select("conv_id", "first", (F.col("t.at") + 1).alias("depth"), "t.a", "t.b", "t.chars")
    return _with_roots(own.unionByName(head), convs)


def _named(turns: DataFrame) -> DataFrame:
    """Each beginning of each conversation: conv_id, first, depth, x, y, parent_x, parent_y, chars, up (the names of its ancestors within its band, from the top, and its own)."""
    step = lambda *order: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(*order))
    t = turns.withColumns({"block": F.floor(F.col("depth") / BLOCK), "step_x": step("depth", "a", "b"), "step_y": step("b", "depth", "a")})
    w = W.partitionBy("conv_id", "block").orderBy("depth")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns({"x": F.expr("bit_xor(step_x)").over(so_far), "y": F.expr("bit_xor(step_y)").over(so_far)})
    t = t.withColumn("up", F.collect_list(F.struct("x", "y")).over(w.rowsBetween(1 - BAND, 0)))
    # What a conversation's earlier blocks come to, a row a block.
    blocks = turns.withColumns({"block": F.floor(F.col("depth") / BLOCK), "step_x": step("depth", "a", "b"), "step_y": step("b", "depth", "a")})
    blocks = blocks.groupBy("conv_id", "block").agg(F.expr("bit_xor(step_x)").alias("carry_x"), F.expr("bit_xor(step_y)").alias("carry_y"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns({c: F.expr(f"bit_xor({c})").over(before) for c in ("carry_x", "carry_y")}).where("block > 0")
    t = t.join(blocks, ["conv_id", "block"], "left")
    carry = lambda of, c: of.bitwiseXOR(F.coalesce(F.col(f"carry_{c}"), F.lit(0).cast("long")))
    x, y = carry(F.col("x"), "x"), carry(F.col("y"), "y")
    n = (F.col("depth") % BAND + 1).cast("int")
    up = F.transform(F.slice("up", -n, n), lambda a: F.struct(carry(a["x"], "x").alias("x"), carry(a["y"], "y").alias("y")))
    return t.select(
        "conv_id", "first", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("step_x")).alias("parent_x"), y.bitwiseXOR(F.col("step_y")).alias("parent_y"), "chars", up.alias("up")
    )


def _to_ancestors(values: DataFrame, sums: list[str]) -> DataFrame:
    """values (depth, up and sums of nodes) added up at the ancestors that up names."""
    top = F.col("depth") - F.col("depth") % BAND
    each = values.select(top.alias("top"), F.posexplode("up").alias("at", "a"), *sums)
    return each.select((F.col("top") + F.col("at")).alias("depth"), "a.x", "a.y", *sums).groupBy(*NODE).agg(*(F.sum(c).alias(c) for c in sums))


def _subtree_totals(values: DataFrame, paths: DataFrame, max_depth: int, sums: list[str]) -> DataFrame:
    """NODE and sums over each node's subtree, itself included.

    values: depth, x, y, parent_x, parent_y, up and sums of each node; paths: conv_id, depth, x, y of each beginning.
    """
    within = _to_ancestors(values, sums)
    if max_depth < BAND:
        return within
    within = written(within, "within")
    # The bands' tops as a trie: each with its total within its band, its parent being the top of the band above.
    tops = paths.where(F.col("depth") % BAND == 0).withColumn("depth", (F.col("depth") / BAND).cast("long"))
    w = W.partitionBy("conv_id", F.floor(F.col("depth") / BAND)).orderBy("depth")
    named = tops.withColumn("up", F.collect_list(F.struct("x", "y")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # Only the topmost of a band is asked for its parent.
    above = tops.where(F.col("depth") % BAND == BAND - 1).select("conv_id", (F.col("depth") + 1).alias("depth"), *(F.col(c).alias(f"parent_{c}") for c in ("x", "y")))
    named = named.join(above, ["conv_id", "depth"], "left")
    named = named.groupBy(*NODE).agg(F.first("up").alias("up"), *(F.first(f"parent_{c}").alias(f"parent_{c}") for c in ("x", "y")))
    own = within.where(F.col("depth") % BAND == 0).withColumn("depth", (F.col("depth") / BAND).cast("long"))
    completed = _subtree_totals(named.join(own, NODE), tops, max_depth // BAND, sums).withColumn("depth", F.col("depth") * BAND)
    # Added up by parent before they meet the parents' ancestors, so that a parent of very many costs a row a task.
    parents = values.where((F.col("depth") % BAND == 0) & (F.col("depth") > 0)).select(*NODE, "parent_x", "parent_y")
    below = completed.join(parents, NODE).groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_x").alias("x"), F.col("parent_y").alias("y")).agg(*(F.sum(c).alias(c) for c in sums))
    bottoms = values.where(F.col("depth") % BAND == BAND - 1).select(*NODE, "up")
    across = _to_ancestors(bottoms.join(below, NODE), sums)
    return within.unionByName(across).groupBy(*NODE).agg(*(F.sum(c).alias(c) for c in sums))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's texts with commas between, which come in order; one text is held at a time."""
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])

    for batch in batches:
        for *own, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if own == node:
                digest.update(b",")
            else:
                if node is not None:
                    yield done()
                node, digest = own, hashlib.sha256()
            digest.update(text.encode())
    if node is not None:
        yield done()


def _ends(paths: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of the nodes at which conversations end: of their ids in decimal, in order, with commas between."""
    last = paths.groupBy("conv_id").agg(F.min("first").alias("first"), *(F.max_by(c, "depth").alias(c) for c in ("x", "y")), F.max("depth").alias("depth"))
    # first rises by one a conversation at least, so that a chunk has BLOCK ids at most.
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = written(last.groupBy(*NODE, F.floor(F.col("first") / BLOCK).alias("chunk")).agg(ids.alias("ids")), "ends")
    several = written(chunks.groupBy(*NODE).agg(F.count("*").alias("n")).where("n > 1").select(*NODE), "several")
    single = chunks.join(several, NODE, "left_anti").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    # A digest is taken in order, so that one node's chunks pass through one task, a chunk at a time.
    rest = chunks.join(several, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return single.unionByName(rest.mapInArrow(_hashed, "depth long, x long, y long, ends_sha256 string"))


def rollup(turns: DataFrame) -> DataFrame:
    """A row a node, long but for the digest: conv_id (the smallest member), depth, parent_conv_id (the parent's conv_id;
    null for the root), n_convs (members: conversations that begin with it), n_children, n_leaves (childless nodes in its
    subtree, itself included), saved_tokens (over its subtree, (n_convs - 1) * code points of the last text), ends_sha256
    (of the ids of the conversations that end here, in decimal and order, with commas between).

    turns: as beginnings() or grafted() give them. Without any conversation there is no node, not even the root.
    """
    ship(turns.sparkSession)
    paths = written(_named(turns), "paths")
    max_depth = paths.agg(F.max("depth")).first()[0] or 0
    same = ("parent_x", "parent_y", "up")  # alike in all members
    nodes = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *(F.first(c).alias(c) for c in same))
    nodes = written(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_x").alias("x"), F.col("parent_y").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    values = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})
    values = written(values, "values")
    totals = _subtree_totals(values.drop("conv_id", "n_convs", "chars", "n_children"), paths.select("conv_id", *NODE), max_depth, ["n_leaves", "saved_tokens"])
    parents = values.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.col("conv_id").alias("parent_conv_id"))
    out = values.drop("up", "chars", "n_leaves", "saved_tokens").join(parents, ["depth", "parent_x", "parent_y"], "left").join(totals, NODE).join(_ends(paths), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )
