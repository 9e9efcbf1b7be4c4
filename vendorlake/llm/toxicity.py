"""Toxicity by class-conditional Kneser-Ney models: the length-normalised log-likelihoods of a text under a toxic and an
ordinary character model, whose rare expressions are smoothed through shared backoff counts.

A text is its lower-cased words (ASCII letters and digits, and everything beyond ASCII) with a space between and one at
the end; its symbols are bytes. With h the ORDER - 1 bytes before x, n_c the counts of class c and D the discount:

    p_c(x | h) = (max(n_c(h x) - D, 0) + B_c(h) * q(x | h')) / n_c(h)          h': h without its first byte

B_c(h) is what the discounts of h's n-grams leave; where a class hasn't seen h, p_c(x | h) = q(x | h'). The backoff q is
one model for both classes, by Kneser-Ney's continuation counts at every lower order: q(x | g) = (max(c(g x) - D, 0) +
D * t(g) * q(x | g')) / c(g), where c(g x) is the number of distinct bytes seen before g x and t(g) that of the
distinct x seen after g; below one byte, 1/256. So an expression that one class alone has is told by its parts. Where
neither class has h x, both have the p(x | h) of their counts together, so that it is no proof of either.

Every n-gram of every labelled text is counted, into a table that grows with the texts; its lower orders and the backoff
are Spark aggregates and joins on keys that have 256 rows at most. A table of up to BROADCAST_ROWS rows goes to every
executor; beyond, documents are dealt into blocks, and the distinct n-grams of a block meet the table by a shuffle, so
that a task holds the counts of its block alone. Either way gives the same scores. The calibration sees each of its
documents by the counts of all the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written
from .shipping import ship
from .wordhash import _LOWER, ALNUM, Words, pieces

D = 0.75
ORDER = 5
#: Tells a context's row from an n-gram's.
_CONTEXT = 1 << (8 * ORDER)
#: Bytes of text in a block of documents that are scored together.
BLOCK_BYTES = 4 << 20
#: Words in the sliding windows whose mean log-likelihood ratio is taken; the highest counts as well as the whole text's.
WINDOW = 8
FEATURES = 6
#: The calibration is fitted on so many labelled documents at most, those of the smallest hashed ids.
FIT_ROWS = 4000
FIT_BLOCKS = 16
#: A model or labels of up to so many rows (24 bytes each in the model) go to every executor; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_TABLE = "key long, n0 long, n1 long, x0 double, x1 double"


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram (ORDER bytes as a number) that ends at each byte of the texts, where each word's bytes and the space after it begin (and the end), and each text's first word."""
    words = Words(texts, ALNUM)
    each = words.end - words.start + 1
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat((ORDER - 1) * (text + 1), each)  # spaces before each text
    spaced = np.full(total + (ORDER - 1) * len(texts), 0x20, np.uint8)
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    source = np.arange(total) + np.repeat(words.start - (ends - each), each)
    spaced[at[inside]] = _LOWER[words.data[source[inside]]]
    g = np.zeros(total, np.int64)
    for back in range(ORDER - 1, -1, -1):
        g = g << 8 | spaced[at - back]
    return g, np.concatenate([[0], ends]).astype(np.int64), words.first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of these texts with their counts by class."""
    for batch in pieces(batches, size=2 << 20):
        g, bounds, first = _grams(batch.column("text"))
        toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds[first]))
        keys, which = np.unique(g, return_inverse=True)
        n = np.bincount(which, minlength=len(keys))
        n1 = np.bincount(which[toxic], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n - n1), pa.array(n1)], ["g", "n0", "n1"])


def _keys(g: np.ndarray) -> np.ndarray:
    """The keys of the table's rows that these n-grams need."""
    own = np.unique(g)
    return np.concatenate([own, np.unique(own >> 8) + _CONTEXT])


def _asked(block: pa.Table) -> pa.Table:
    keys = _keys(_grams(block.column("text").combine_chunks())[0])
    return pa.table({"block": np.full(len(keys), block.column("block")[0].as_py(), np.int64), "key": keys})


class Counts:
    """Rows of the table, by key: of an n-gram n0, n1 and q (x0); of a context its counts n0, n1 and what the discounts leave of each (x0, x1)."""

    def __init__(self, rows: pa.Table):
        key = rows.column("key").to_numpy()
        order = np.argsort(key)
        self.key = key[order]
        self.n = np.stack([rows.column(c).to_numpy()[order] for c in ("n0", "n1")]).astype(np.int32)
        self.x = np.stack([rows.column(c).to_numpy()[order] for c in ("x0", "x1")]).astype(np.float32)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros((2, len(keys))), np.zeros((2, len(keys)))
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        known = self.key[at] == keys
        return np.where(known, self.n[:, at], 0).astype(float), np.where(known, self.x[:, at], 0).astype(float)

    def ratios(self, g: np.ndarray, counted: int | None = None) -> np.ndarray:
        """log p_toxic - log p_ordinary at each n-gram; counted: these are all n-grams of one text counted in this class, and its own counts don't count."""
        keys, which, own = np.unique(g, return_inverse=True, return_counts=True)
        n, (q, _) = self.of(keys)
        contexts, context = np.unique(keys >> 8, return_inverse=True)
        t, left = self.of(contexts + _CONTEXT)
        if counted is not None:
            now = n[counted] - own
            left[counted] -= np.bincount(context, np.minimum(n[counted], D) - np.minimum(now, D), minlength=len(contexts))
            t[counted] -= np.bincount(context, own, minlength=len(contexts))
            n[counted] = now
        logs, known = [], n.sum(0) > 0
        for c in (0, 1):
            seen = t[c] > 0
            most, rest = np.where(seen, t[c], 1.0), np.where(seen, np.maximum(left[c], D), 1.0)
            logs.append(np.log(np.where(known, (np.maximum(n[c] - D, 0) + rest[context] * q) / most[context], 1.0)))
        return (logs[1] - logs[0])[which]

    def features(self, texts: pa.Array, counted: int | None = None) -> np.ndarray:
        """Of each text: the highest mean of WINDOW words in a row, the mean of all its bytes, the two highest words, the logarithm of its words, and the words' excess over 2."""
        g, bounds, first = _grams(texts)
        total = np.concatenate([[0.0], np.cumsum(self.ratios(g, counted))])
        value = np.diff(total[bounds])
        total = total[bounds]
        excess = np.concatenate([[0.0], np.cumsum(np.maximum(value - 2, 0))])
        out = np.zeros((len(texts), FEATURES))
        for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if n := b - a:
                best = (total[a + WINDOW : b + 1] - total[a : b + 1 - WINDOW]).max() if n > WINDOW else total[b] - total[a]
                high = np.partition(value[a:b], n - 2)[-2:] if n > 1 else (0.0, value[a])
                out[d] = best / WINDOW, (total[b] - total[a]) / (bounds[b] - bounds[a]), high[1], high[0], np.log1p(n), (excess[b] - excess[a]) / n**0.5
        return out


class Model:
    """table: (key, n0, n1, x0, x1) as in Counts; held: its rows for every executor, if they are few; and the calibration."""

    def __init__(self, table: DataFrame, broadcast_rows: int):
        self.table = table
        self.held = table.sparkSession.sparkContext.broadcast(Counts(table.toArrow())) if table.count() <= broadcast_rows else None
        self.mean, self.scale, self.weights = _calibrated(np.zeros((0, FEATURES)), np.zeros(0))

    def apply(self, docs: DataFrame, run, schema: str) -> DataFrame:
        """run(rows of docs with a column block, their Counts) -> an Arrow table, over all of docs."""
        names = [part.split()[0] for part in schema.split(", ")]
        if (held := self.held) is not None:

            def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in pieces(source, size=1 << 20):
                    yield from run(pa.Table.from_batches([batch]), held.value).select(names).combine_chunks().to_batches()

            return docs.mapInArrow(batches, schema)
        rows = docs.select("block", "text").groupBy("block").applyInArrow(_asked, "block long, key long").join(self.table, "key")
        return docs.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(lambda block, asked: run(block, Counts(asked)).select(names), schema)


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(1 + FEATURES)
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -4.0
    ridge = np.diag([1e-6, *[0.05] * FEATURES])
    for _ in range(30 if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _features(rows: pa.Table, counts: Counts) -> pa.Table:
    texts, toxic = rows.column("text").combine_chunks(), rows.column("toxic").to_numpy().astype(np.int8)
    x = [counts.features(texts[i : i + 1], int(toxic[i])) for i in range(len(texts))]
    return pa.table({"toxic": toxic, **dict(zip("abcdef", np.concatenate(x).T, strict=True))})


def table_of(grams: DataFrame) -> DataFrame:
    """The model's table from the n-grams' counts (g, n0, n1)."""
    shorter = lambda c, k: F.col(c).bitwiseAND((1 << 8 * k) - 1)
    counts = {ORDER: grams.select("g")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = counts[k + 1].groupBy(shorter("g", k).alias("g")).agg(F.count("*").alias("c"))
    around = W.partitionBy(F.shiftright("g", 8))  # at most 256 rows
    q = None
    for k in range(1, ORDER):
        level = counts[k].withColumns({"t": F.count("*").over(around), "all": F.sum("c").over(around)})
        lower = F.lit(1 / 256) if q is None else F.col("q")
        level = level if q is None else level.withColumn("h", shorter("g", k - 1)).join(q.withColumnRenamed("g", "h"), "h")
        q = level.select("g", ((F.col("c") - D + D * F.col("t") * lower) / F.col("all")).alias("q"))
    known = grams.withColumn("h", shorter("g", ORDER - 1)).join(q.withColumnRenamed("g", "h"), "h")
    left = lambda c: F.sum(F.least(F.col(c).cast("double"), F.lit(D)))
    contexts = grams.groupBy((F.shiftright("g", 8) + _CONTEXT).alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), left("n0").alias("x0"), left("n1").alias("x1"))
    return known.select(F.col("g").alias("key"), "n0", "n1", F.col("q").alias("x0"), F.lit(0.0).alias("x1")).unionByName(contexts)


def fit(
    labelled_ids: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> Model:
    """The model of docs' texts under labelled_ids' labels (1 toxic, 0 ordinary; null labels and ids are left out, a repeated id counts by its highest label).

    N-grams are counted over all labelled texts, exact copies once and by the label that most of them have, so that a much
    copied text does not make its own words toxic; the calibration's few weights are fitted on fit_rows of them. Without
    labelled texts every score is the same low one.
    """
    ship(docs.sparkSession)
    labels = labelled_ids.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    labels = labels.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    copies = d.select("id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")).join(labels, "id").groupBy("h1", "h2")
    labels = written(copies.agg(F.min("id").alias("id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")).groupBy("id").agg(F.max("toxic").alias("toxic")), "labels")
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels.hint("shuffle_hash")
    # A row repeated under its id counts as often as it stands.
    texts = d.join(labels, "id").select("text", "toxic")
    grams = texts.mapInArrow(_counted, "g long, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    model = Model(written(table_of(written(grams, "grams")), "table"), broadcast_rows)

    chosen = F.broadcast(labels.orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    chosen = d.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).where("text is not null")  # one text an id
    chosen = chosen.select(F.pmod(F.xxhash64("id"), F.lit(FIT_BLOCKS)).alias("block"), "text", "toxic")
    x = model.apply(chosen, _features, ", ".join(["toxic byte", *(f"{c} double" for c in "abcdef")])).toArrow().sort_by([(c, "ascending") for c in ("toxic", *"abcdef")])
    columns = [x.column(c).to_numpy().astype(float) for c in "abcdef"]
    model.mean, model.scale, model.weights = _calibrated(np.column_stack(columns), x.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and score (double, 0 to 1). Null and empty texts get what the calibration gives a
    text without words; null ids stay null; repeated rows come out as often as they came in; other columns are ignored.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model.held is None:
        n_bytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        d = d.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_bytes // BLOCK_BYTES + 1)))
    kind = d.schema["id"].dataType.simpleString()
    mean, scale, weights = model.mean, model.scale, model.weights

    def run(rows: pa.Table, counts: Counts) -> pa.Table:
        x = (counts.features(rows.column("text").combine_chunks()) - mean) / scale
        return pa.table([rows.column("id"), pa.array(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -35, 35))))], ["id", "score"])

    return model.apply(d, run, f"id {kind}, score double").withColumnRenamed("id", id_col)
