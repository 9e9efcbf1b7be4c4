"""N-gram Jaccard join: documents whose shingle sets are similar enough, found by PartEnum signatures.

Sets are dealt into size bands so narrow that two linked sets lie in one band or in neighbouring ones; each set signs for
its own band and for the next. Within a band two linked sets differ in at most k shingles. The shingle domain is cut by
hash into n > k parts, so at least n - k parts hold the same shingles in both sets, and both sets sign some subset of the
parts alike:

- k = 0: one part, the whole set. k up to 3: every subset of n - k parts out of n = 4, 5 or 6.
- up to MANY parts: n = k + 3 parts, each part that holds enough shingles by itself (a subset of one). If all three equal
  parts are light ones, the subset of those three is signed too; so no pair is lost, and light parts, which unrelated
  sets share by chance, never sign alone.
- more parts: n = k + 1 + m, where m is more empty parts than sets of the band have but for one in hundreds. Of the m + 1
  equal parts one is not empty, unless both sets have over m empty parts; so the parts that are not empty sign, and only
  in a set with over m empty ones do those sign too.

A signature met by two sets makes them candidates, and candidates are verified on their exact sets. Stock passages fill
whole parts of sets that are not linked, and such a part's signature may be met by very many. With n = k + 1 + m parts
two linked sets have m + 1 equal ones, so a set with j empty parts may leave out the m - j of its signatures that most
sets meet: of the equal parts that are not empty, the one that fewest sets meet is left out by neither. So a set that
meets others in no more than m - j parts has no link at all, and only sets that consist of stock passages for the most
part, or of near copies of one another, are looked up by such parts.

A bucket of more than two sets is not compared all with all:

1. Each member is compared with the bucket's leader, the set that meets most others, and with the leader's root: the end
   of the chain from a set to the heaviest leader it meets. One root serves many buckets of a group.
2. Where this leaves several components in a bucket, its members are known by what they differ in from the root. Two
   members x and y differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)| shingles. If both differ little, both are linked to the
   root already; else they can only be linked if their differences overlap enough, and such pairs are found by a prefix
   and positional filter over the differences, added shingles before missing ones. Copies that were edited in different
   places share no added shingles and never meet. By the positions px, py of the first shared one at least px + py
   shingles differ, so one of the two positions lies within its set's half of what may differ: only such rows are joined
   with all others.

So a group of near copies costs about one comparison a member, and no link is lost to the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, written
from .shipping import ship
from .wordhash import SPACED, Words, mix, pieces, shingles


#: Beyond so many parts only empty ones count as light.
MANY = 12
#: Pairs of one leader up to so many are joined with its set in one task; more are dealt over several.
DEALT = 4096
#: Rows of (leader, number of deals) that go to every executor; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000


class Bands:
    """Size bands and parts for the link condition whole * |A and B| >= part * |A or B|."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole
        self.cut: dict[int, tuple[int, int]] = {}
        self.tops = [max(1, (whole + part - 1) // (2 * (whole - part)))]

    def of(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * self.whole // self.part))
        return int(np.searchsorted(self.tops, size))

    def differ(self, band: int) -> int:
        """The most shingles by which two linked sets of this band, or of it and the one below, can differ."""
        while len(self.tops) <= band:
            self.of(self.tops[-1] + 1)
        return (self.whole - self.part) * 2 * self.tops[band] // (self.whole + self.part)

    def parts(self, band: int) -> tuple[int, int]:
        """(n, m): the parts of a band, and how many empty ones a set has at most if it needn't sign them."""
        if band not in self.cut:
            k = self.differ(band)
            n, m = (1, 0) if k == 0 else (k + 3, 2)
            if n > MANY:
                least = self.tops[band - 2] + 1  # the smallest set that signs for this band
                for _ in range(50):
                    empty = n * math.exp(-least / n)
                    n, m = k + 1 + m, max(m, math.ceil(empty + 3 * math.sqrt(empty)))
            self.cut[band] = (k + 1 + m, m) if n > MANY else (n, m)
        return self.cut[band]

    def signatures(self, sorted_set: np.ndarray) -> np.ndarray:
        return np.concatenate([s for s, _ in self.signed(sorted_set)])

    def signed(self, sorted_set: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """For its own band and for the next: the signatures, and how many of them may be left out."""
        own = self.of(len(sorted_set))
        return [self._sign(sorted_set, own), self._sign(sorted_set, own + 1)]

    def _sign(self, elements: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        k, (n, m) = self.differ(band), self.parts(band)
        where = (mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(33)) % np.uint64(n)
        order = np.argsort(where, kind="stable")
        counts = np.bincount(where.astype(np.int64), minlength=n)
        ends = np.cumsum(counts)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements[order] + np.uint64(1)), dtype=np.uint64)])
        content = mix(total[ends] - total[ends - counts] + counts.astype(np.uint64))
        tag = mix(np.uint64(band << 32) + np.arange(n, dtype=np.uint64))
        part = mix(content ^ tag)
        if n == 1:
            return part, 0
        if k <= 3:
            subsets = np.array(list(combinations(range(n), n - k)))
            return mix(part[subsets].sum(1, dtype=np.uint64)), 0
        if n > MANY:
            spare = m - int((counts == 0).sum())
            return (part, 0) if spare < 0 else (part[counts > 0], spare)
        light = np.flatnonzero(counts < 2)
        heavy = np.delete(part, light)
        if len(light) < 3:
            return heavy, 0
        subsets = np.array(list(combinations(light.tolist(), 3)))
        return np.concatenate([heavy, mix(part[subsets].sum(1, dtype=np.uint64))]), 0


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    words = Words(batch.column("text"), SPACED)
    with np.errstate(over="ignore"):
        for run in shingles(words.numbers(), words.first, width):
            yield np.unique(run)


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = np.zeros((3, batch.num_rows), np.int64)
            with np.errstate(over="ignore"):
                for i, s in enumerate(_sets(batch, width)):
                    out[:, i] = len(s), mix(s).sum(dtype=np.uint64).astype(np.int64), mix(s + np.uint64(77)).sum(dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out)], ["id", "n_shingles", "h1", "h2"])

    return run


def _packed(ids: pa.Array, lists: list[np.ndarray], **more: list[int]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    values = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    arrays = [ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), *(pa.array(x, pa.int32()) for x in more.values())]
    return pa.RecordBatch.from_arrays(arrays, ["id", "numbers", *more])


def _elements(width: int):
    """id and the numbers of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=1 << 20):
            with np.errstate(over="ignore"):
                yield _packed(batch.column("id"), list(_sets(batch, width)))

    return run


def _signed(width: int, bands: Bands):
    """Two rows a set: id, the signatures for one band, and twice the number of those that may be left out, plus 1 for the upper band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=1 << 20):
            with np.errstate(over="ignore"):
                both = [x for s in _sets(batch, width) for x in bands.signed(s)]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), 2)))
            yield _packed(ids, [s for s, _ in both], spare=[2 * n + i % 2 for i, (_, n) in enumerate(both)])

    return run


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with their sets a and b; the pairs of one v are dealt over several keys where they are many."""
    many = written(pairs.groupBy("v").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("deals")).where("deals > 1"), "many")
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    a, b = (sets.select(F.col("id").alias(k), F.col("numbers").alias(n)) for k, n in (("u", "a"), ("v", "b")))
    dealt = pairs.join(many, "v", "left").withColumn("deal", F.when(F.col("deals").isNull(), 0).otherwise(F.pmod(F.xxhash64("u"), F.col("deals"))).cast("int")).drop("deals")
    copies = b.join(many, "v", "left").select("v", "b", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("deals"), F.lit(1)) - 1)).alias("deal"))
    return dealt.join(a, "u").join(copies, ["v", "deal"]).drop("deal")


def _roots(to: DataFrame) -> DataFrame:
    """to: each node's heaviest leader, itself if none is heavier -> the end of each node's chain, by pointer jumping."""
    to = written(to, "to")
    while True:
        jumped = to.join(to.select(F.col("id").alias("to"), F.col("to").alias("then")), "to", "left").select("id", F.coalesce("then", "to").alias("next"), "to")
        last, jumped = to, written(jumped, "to")
        discard(last)
        if jumped.where("next <> to").isEmpty():
            return jumped.select("id", "to")
        to = written(jumped.select("id", F.col("next").alias("to")), "to")
        discard(jumped)


def _linked(size_a, size_b, differ, part: int, whole: int):
    """Whether sets of these sizes that differ in so many shingles are linked: whole * |A and B| >= part * |A or B|."""
    at = lambda x: F.col(x) if isinstance(x, str) else x
    return (whole + part) * differ <= (whole - part) * (at(size_a) + at(size_b))


def _buckets(d: DataFrame, ids: DataFrame, bands: Bands, width: int) -> DataFrame:
    """(sig, id, n): the signatures that n > 1 of the sets have, without those that a set may leave out."""
    signed = (
        d.join(ids.hint("shuffle_hash"), "id", "left_semi")
        .mapInArrow(_signed(width, bands), "id long, numbers array<long>, spare int")
        .select("id", F.explode("numbers").alias("sig"), "spare")
    )
    w = W.partitionBy("sig")
    met = signed.withColumns({"lo": F.min("id").over(w), "hi": F.max("id").over(w), "n": F.count("*").over(w)})
    order = W.partitionBy("id", "spare").orderBy(F.desc("n"), "sig")  # at most the signatures of one set
    needed = met.where("lo < hi").withColumn("k", F.row_number().over(order)).where(F.col("k") > F.shiftright("spare", 1))
    return written(needed.select("sig", "id", "n"), "buckets")


def _rooted(buckets: DataFrame) -> DataFrame:
    """(sig, id, leader, root)."""
    weighed = buckets.join(buckets.groupBy("id").agg(F.sum("n").alias("weight")), "id")
    leaders = weighed.groupBy("sig").agg(F.max(F.struct(F.col("weight"), -F.col("id"))).alias("m")).select("sig", F.col("m.weight"), (-F.col("m.col2")).alias("leader"))
    led = written(buckets.select("sig", "id").join(leaders, "sig"), "led")
    roots = _roots(led.groupBy("id").agg(F.max(F.struct(F.col("weight"), -F.col("leader"))).alias("m")).select("id", (-F.col("m.col2")).alias("to")))
    rooted = written(led.select("sig", "id", "leader").join(roots.select(F.col("id").alias("leader"), F.col("to").alias("root")), "leader"), "rooted")
    discard(led)
    return rooted


def _verified(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    links = _paired(pairs, sets).withColumn("same", F.size(F.array_intersect("a", "b")))
    return links.where(_linked(F.size("a"), F.size("b"), F.size("a") + F.size("b") - 2 * F.col("same"), part, whole)).select("u", "v")


def near_pairs(still: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Of still (u, root v, component c of u): pairs of a root's members in different components whose differences from it leave open that they are linked."""
    added, missing = (F.array_sort(F.array_except(*ab)) for ab in (("a", "b"), ("b", "a")))
    differ = _paired(still, sets).select("u", "v", "c", F.size("a").alias("n"), F.concat(added, missing).alias("apart"))
    reach = F.floor(F.col("n") * ((whole - part) * (whole + part)) / ((whole + part) * part)).cast("int") + 1
    open_ = differ.select("u", "v", "c", "n", F.size("apart").alias("d"), F.posexplode(F.slice("apart", F.lit(1), reach)).alias("p", "e"))
    open_ = written(open_, "open")
    x, y = (open_.select("v", "e", *(F.col(c).alias(f"{c}{k}") for c in "ucndp")) for k in "xy")
    x = x.where((whole + part) * F.col("px") <= (whole - part) * F.col("nx"))
    shared = F.least(F.col("dx") - F.col("px"), F.col("dy") - F.col("py"))
    near = x.join(y, ["v", "e"]).where((F.col("cx") != F.col("cy")) & _linked("nx", "ny", F.col("dx") + F.col("dy") - 2 * shared, part, whole))
    near = written(near.select(F.greatest("ux", "uy").alias("u"), F.least("ux", "uy").alias("v")).distinct(), "near")
    discard(open_)
    return near


def _linked_components(d: DataFrame, ids: DataFrame, width: int, part: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """The links found (u, v), a written table, and their components (node, component)."""
    buckets = _rooted(first := _buckets(d, ids, Bands(part, whole), width))
    discard(first)
    to = buckets.select(F.col("id").alias("u"), F.explode(F.array("leader", "root")).alias("v"))
    pairs = written(to.where("u <> v").distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    sets = written(d.join(wanted.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_elements(width), "id long, numbers array<long>"), "sets")
    links = written(_verified(pairs, sets, part, whole), "links")
    discard(pairs)
    found = written(components(links), "found")

    # Buckets that still hold members of different components.
    member = buckets.join(found.withColumnRenamed("node", "id"), "id", "left").select("sig", "id", "root", F.coalesce("component", "id").alias("c"))
    mixed = member.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig")
    still = member.where("id <> root").join(mixed, "sig", "left_semi").select(F.col("id").alias("u"), F.col("root").alias("v"), "c").distinct()
    still = written(still, "still")
    discard(buckets)
    near = near_pairs(still, sets, part, whole)
    more = written(_verified(near, sets, part, whole), "more")
    discard(still, near, sets)
    if more.isEmpty():
        return links, found
    # Components that such links join.
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}c"))
    ends = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v"))
    joined = written(components(ends), "joined")
    nodes = found.unionByName(joined.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    named = nodes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return links, named.select("node", F.coalesce("to", "component").alias("component"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """Groups of documents connected by whole * |A and B| >= part * |A or B|, where A and B are the documents' sets of
    width-word shingles (words: between ASCII white space, A-Z lower-cased; fewer words than width: one shingle of all).

    One row per row of docs: id_col, n_shingles (long), component_id (the smallest id reachable, the own one included).
    Null or empty texts and texts of white space have no shingle and stay alone. A null id is kept, links nothing, and is
    its own component (null). Repeated rows come out as often as they came in; rows that share an id are one document to
    the links, which any of its texts may make. Other columns of docs are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    digests = written(d.mapInArrow(_digests(width), "id long, n_shingles long, h1 long, h2 long"), "digests")
    filled = digests.where("n_shingles > 0 and id is not null")
    reps = written(filled.groupBy("n_shingles", "h1", "h2").agg(F.min("id").alias("rep")), "classes")
    links, found = _linked_components(d, reps.select(F.col("rep").alias("id")).distinct(), width, part, whole)
    discard(links)

    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    return digests.join(named, ["n_shingles", "h1", "h2"], "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id")
    )
