"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two). An item's MinHash sketch is the r least mixed
hashes of its q shingles, with r = q - need + 1 and need = the fewest shared shingles that reach the threshold: a
document that holds `need` of the q shingles must hold at least one of any r of them, so the search misses nothing, at
any document length. A document is only looked up in partitions whose least need it can fill. Each hit is verified by
exact shingle containment on the words themselves.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dealt import dealt
from .scratch import discard, written
from .shipping import ship
from .wordhash import ALNUM, Words, mix, pieces, shingles

#: Item texts of up to so many bytes in total go to every executor; beyond, the sketches are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bits that tell which shingles of documents may be in a sketch, in the join by a shuffle.
BITS = 1 << 26
#: About how many items a text is held against at a time there.
ITEMS = 64
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_FOUND = "id long, item_id long, n_shingles long, n_shared long"


def exact_shingles(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    words = _WORD.findall((text or "").encode().lower())
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _need(q: int, part: int, whole: int) -> int:
    return max(1, -(-part * q // whole))


def _hashed(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    words = Words(texts, ALNUM)
    with np.errstate(over="ignore"):
        yield from shingles(words.numbers(), words.first, width)


def _sketch(elements: np.ndarray, part: int, whole: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        order = np.argsort(mix(elements))
    return elements[order[: len(elements) - _need(len(elements), part, whole) + 1]]


class Items:
    """The items' sketches by size partition, and their exact shingles."""

    def __init__(self, ids: list, texts: list[str], width: int, part: int, whole: int):
        self.ids, self.width, self.part, self.whole = ids, width, part, whole
        self.exact = [exact_shingles(t, width) for t in texts]
        parts = defaultdict(list)
        for i, run in enumerate(_hashed(pa.array(texts, pa.large_string()), width)):
            if len(elements := np.unique(run)):
                parts[len(elements).bit_length()].append((i, elements))
        self.parts = []  # least need, sorted sketch elements, the item of each
        for held in parts.values():
            sketches = [(i, _sketch(e, part, whole)) for i, e in held]
            keys = np.concatenate([s for _, s in sketches])
            owner = np.repeat([i for i, _ in sketches], [len(s) for _, s in sketches])
            order = np.argsort(keys)
            self.parts.append((min(_need(len(e), part, whole) for _, e in held), keys[order], owner[order]))
        self.low = np.zeros(1 << 20, bool)
        for _, keys, _ in self.parts:
            self.low[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, run: np.ndarray) -> set[int]:
        """Items of which the document with these shingles (repeats allowed) holds a sketch element."""
        hits = run[self.low[(run & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        found: set[int] = set()
        for need, keys, owner in self.parts if len(hits) else ():
            if len(run) >= need:
                a, b = np.searchsorted(keys, hits, "left"), np.searchsorted(keys, hits, "right")
                for x, y in zip(a[b > a].tolist(), b[b > a].tolist(), strict=True):
                    found.update(owner[x:y].tolist())
        return found


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in pieces(batches):
            rows = []
            ids, texts = batch.column("id"), batch.column("text")
            for d, doc in enumerate(_hashed(texts, items.width)):
                if len(doc) and (found := items.candidates(doc)):
                    own = exact_shingles(texts[d].as_py(), items.width)
                    for i in sorted(found):
                        n = len(items.exact[i] & own)
                        if items.whole * n >= items.part * len(items.exact[i]):
                            rows.append((ids[d].as_py(), items.ids[i], len(items.exact[i]), n))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item_id", "n_shingles", "n_shared"])

    return run


def _hit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _listed(width: int, part: int, whole: int, shared=None):
    """(id, h): the row's sketch; with shared bits, instead those of all its shingle hashes that the bits name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=1 << 20):
            sets = [np.unique(run) for run in _hashed(batch.column("text"), width)]
            found = [e[_hit(shared.value, e)] if shared else _sketch(e, part, whole) for e in sets]
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(len(found)), [len(e) for e in found])))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found).astype(np.int64))], ["id", "h"])

    return run


def _bits(sketches: DataFrame):
    """Which values of BITS the hashes h take, on every executor: a bit each, 8 MB however many hashes there are."""
    word = F.shiftright(F.col("h").bitwiseAND(BITS - 1), 6).cast("int")
    words = sketches.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("mask")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return sketches.sparkSession.sparkContext.broadcast(bits)


def _checked(width: int, part: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for d, held in enumerate(batch.column("items").to_pylist()):
                own = exact_shingles(batch.column("text")[d].as_py(), width)
                for i in held:
                    item = exact_shingles(i["item"], width)
                    n = len(item & own)
                    if whole * n >= part * len(item):
                        rows.append((batch.column("id")[d].as_py(), i["item_id"], len(item), n))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item_id", "n_shingles", "n_shared"])

    return run


def _by_shuffle(d: DataFrame, b: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """_FOUND for items (item_id, item) of any number.

    Documents give only the hashes that the sketches' bits name. A shingle that many documents hold, and an item that many
    meet, are dealt over groups by a salt. A document's text goes with up to about ITEMS of its items at a time.
    """
    b = written(b.distinct().withColumn("bn", F.xxhash64("item_id", "item")), "items")
    keyed = d.withColumn("dn", F.xxhash64("id", "text"))
    sketches = b.select(F.col("bn").alias("id"), F.col("item").alias("text")).mapInArrow(_listed(width, part, whole), "id long, h long")
    sketches = written(sketches.withColumnRenamed("id", "bn"), "sketches")
    hits = keyed.select(F.col("dn").alias("id"), "text").mapInArrow(_listed(width, part, whole, _bits(sketches)), "id long, h long")
    hits = written(hits.withColumnRenamed("id", "dn"), "hits")
    many, few = dealt(hits, sketches, ["h"], F.col("dn"))
    pairs = written(many.join(few, ["h", "salt_"]).select("dn", "bn").distinct(), "pairs")
    discard(hits, sketches)
    groups = pairs.groupBy("dn").agg(F.ceil(F.count("*") / ITEMS).alias("groups"))
    many, few = dealt(pairs, b, ["bn"], F.col("dn"))
    met = many.join(few, ["bn", "salt_"]).join(groups, "dn").withColumn("group", F.pmod(F.xxhash64("bn"), F.col("groups")))
    held = met.groupBy("dn", "group").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    return held.join(keyed, "dn").select("id", "text", "items").mapInArrow(_checked(width, part, whole), _FOUND)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    part: int = 80,
    whole: int = 100,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per (document, item) with whole * |item and document| >= part * |item|, over sets of width-word shingles:
    id_col, item_id (long), n_shingles (of the item), n_shared (long), containment (double).

    Words: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased; fewer words than width make one
    shingle of all, which only a document of exactly those words holds. Null or empty texts, and texts without a word, on
    either side match nothing. Repeated rows count as one: each (document, item) pair of ids comes out once, with the
    best of its texts. A null id is kept as a null. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    b = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).where("item is not null")
    size = b.agg(F.coalesce(F.sum(F.octet_length("item") + 8), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        rows = b.collect()
        held = Items([r["item_id"] for r in rows], [r["item"] for r in rows], width, part, whole)
        found = d.mapInArrow(_searched(docs.sparkSession.sparkContext.broadcast(held)), _FOUND)
    else:
        found = _by_shuffle(d, b, width, part, whole)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared", "n_shingles")).alias("m"))
    return best.select(
        F.col("id").alias(id_col), "item_id", "m.n_shingles", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment")
    )
