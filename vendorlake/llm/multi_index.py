"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each half quantised by its own codebook of K centroids; a vector lives in the cell of its
two nearest centroids, so K + K centroids give K * K cells, and K grows with the number of vectors. A query scores each
half's centroids, and a heap walks the pairs of centroids from the best summed score down, until the cells passed hold
`probe` vectors. Their entries are reranked by the exact inner product.

How many vectors a query must pass depends on the data: nearest neighbours of vectors without structure lie almost
anywhere, and the more vectors there are, the nearer to the walk's beginning. So `probe` is measured: TRIALS queries are
compared with all vectors, and `probe` is what RECALL of their true neighbours needs.

The codebooks are fitted on a bounded sample (SAMPLE vectors, those of the smallest hashed ids); every vector is indexed.
Neighbouring cells form buckets of about BLOCK entries, a crowded cell several; a query goes once to each bucket in which
it has a cell, with the score down to which it walks, and is compared with the entries of its own cells there. Searches
are dealt out by bucket and by part of about QUERIES queries, so neither a crowded cell nor a popular one is one task's
work. The bucket of a query's best cell comes first and hands on its `k` best; the others hand on what is as good as the
last of these, at most `k` each, so that what is handed on grows much less than the number of buckets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written
from .shipping import ship

SAMPLE, BLOCK, QUERIES, ROUNDS = 8192, 8192, 4096, 12
#: Queries in a task that walks.
WALKS = 256
#: The fewest and the most centroids of a half.
CENTROIDS = (16, 128)
#: So many queries, those of the smallest hashed ids, are compared with all vectors; the walk's length is what this share of their true neighbours needs.
TRIALS, RECALL = 128, 0.95
#: Queries scored together within a bucket.
_TOGETHER = 512


def centroids_for(n: int) -> int:
    """About a fourth of the root of the number of vectors, so that cells grow with its root, as a power of two."""
    return int(np.clip(2 ** round(np.log2(max(n, 1)) / 2 - 2), *CENTROIDS))


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from k distinct rows; an empty cluster keeps its centroid."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    flat = vectors.flatten() if vectors.offset == 0 else pa.concat_arrays([vectors]).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def cells_by_score(a: np.ndarray, b: np.ndarray, counts: np.ndarray, probe: float) -> list[int]:
    """Cells i * len(b) + j in order of falling a[i] + b[j], by the multi-sequence walk, until those passed hold `probe` entries or none is left."""
    order_a, order_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    heap, out, held, done = [(-(a[order_a[0]] + b[order_b[0]]), 0, 0)], [], 0, [0] * (len(order_a) + 1)
    while heap and held < probe:
        _, i, j = heapq.heappop(heap)
        cell = order_a[i] * len(b) + order_b[j]
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        done[i] = j + 1
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[order_a[i]] + b[order_b[j + 1]]), i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (-(a[order_a[i + 1]] + b[order_b[j]]), i + 1, j))
    return out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) without vectors that are null, empty, zero or hold a null or non-finite component, of the most common length."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(~F.exists("v", odd) & F.exists("v", lambda x: x != 0))


def nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest finite scores of each row, by row; ties go to the smaller id of a column."""
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if scores.shape[1] > k else -np.inf
    row, column = np.nonzero((scores >= kth) & np.isfinite(scores))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def _dot(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Inner products, summed in one order whatever the number of rows, so that equal vectors score alike."""
    return np.einsum("qd,nd->qn", queries, entries)


def _walk_needed(index: DataFrame, asking: DataFrame, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, k: int, recall: float) -> int:
    """How many vectors queries walk past so that a share `recall` of the true k nearest are among them, from TRIALS queries compared with all vectors."""
    trials = asking.orderBy(F.xxhash64("id"), "id").limit(TRIALS).toPandas()
    if not len(trials):
        return 1
    (a, b), half = books, books[0].shape[1]
    own, wanted = trials["id"].to_numpy(), np.stack(trials["v"].to_numpy()).astype(float)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each trial among a task's vectors: trial, id, score, cell."""
        held = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))] * len(wanted)
        for batch in batches:
            ids, cells = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
            for at in range(0, len(ids), BLOCK):
                some = slice(at, at + BLOCK)
                scores = _dot(wanted, _matrix(batch.column("v").slice(at, BLOCK), wanted.shape[1]))
                scores[own[:, None] == ids[None, some]] = -np.inf
                row, column = nearest(ids[some], scores, k)
                new = (row, ids[some][column], scores[row, column], cells[some][column])
                for t in np.unique(row).tolist():
                    both = [np.concatenate([x, y[row == t]]) for x, y in zip(held[t], new, strict=True)]
                    best = np.lexsort((both[1], -both[2]))[:k]
                    held[t] = tuple(x[best] for x in both)
        trial, ids, scores, cells = (np.concatenate(x) for x in zip(*held, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(trial, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(cells, pa.int32())], ["trial", "id", "score", "cell"])

    found = index.mapInArrow(exact, "trial int, id long, score double, cell int")
    best = W.partitionBy("trial").orderBy(F.desc("score"), "id")  # k rows a task and trial
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("trial", "cell").toPandas()  # at most TRIALS * k rows
    needed = []
    for t, cells in found.groupby("trial")["cell"]:
        order = np.array(cells_by_score(a @ wanted[t, :half], b @ wanted[t, half:], counts, counts.sum()))
        before = np.zeros(len(counts), np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        needed.append(before[cells.to_numpy()] + 1)
    return int(np.quantile(np.concatenate(needed), recall, method="higher")) if needed else 1


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    centroids: int | None = None, sample: int = SAMPLE, probe: float | None = None, recall: float = RECALL, queries_a_block: int = QUERIES,
) -> DataFrame:
    """The k vectors found nearest to each query by inner product (double precision), other than the one of the query's
    own id: query_id (long), rank (int, from 1), id_col (long), score (double); ties go to the smaller id.

    centroids: of a half, centroids_for() the number of vectors by default. probe: the share of the vectors that a query
    walks past; what the share `recall` of the true neighbours needs by default. Vectors and queries that are null, zero, or
    hold null or non-finite components take no part, nor do those of another length than the sample's most common one, nor
    null ids. Fewer candidates than k give fewer rows. A repeated id counts once a vector. Other columns are ignored,
    whatever their names.
    """
    spark = ship(vectors.sparkSession)
    result = f"query_id long, rank int, {id_col} long, score double"
    base = valid(vectors, id_col, vector_col).distinct()
    fit = base.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(fit):
        return spark.createDataFrame([], result)
    dim = int(fit["v"].map(len).mode()[0])
    x = np.stack([v for v in fit["v"] if len(v) == dim])
    x = x[np.lexsort(x.T)]  # one order whatever order the rows came in
    half = dim // 2
    base = base.where(F.size("v") == dim)
    k_half = centroids or centroids_for(len(x) if len(fit) < sample else base.count())
    books = (_kmeans(x[:, :half], k_half, 1), _kmeans(x[:, half:], k_half, 2))
    held = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = held.value
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            cell = _nearest(m[:, :half], a) * len(b) + _nearest(m[:, half:], b)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    index = written(base.mapInArrow(assign, "id long, v array<double>, cell int"), "index")
    sizes = index.groupBy("cell").agg(F.count("*").alias("n")).toPandas()  # at most a row a cell
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    counts[sizes["cell"].to_numpy(int)] = sizes["n"].to_numpy()
    # Cells in order, cut into buckets wherever another BLOCK of entries is full; a crowded cell's entries are dealt over several blocks.
    bucket = ((np.cumsum(counts) - counts) // BLOCK).astype(np.int32)
    blocks = np.maximum((counts + BLOCK - 1) // BLOCK, 1)
    asking = written(valid(queries, id_col, vector_col).distinct().where(F.size("v") == dim), "asking")
    walk = _walk_needed(index, asking, books, counts, k, recall) if probe is None else probe * counts.sum()
    walk = max(walk, k + 1)  # the query itself may be among them
    layout = spark.sparkContext.broadcast((counts, bucket, blocks))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of each bucket that holds a cell of a query's walk. Its last cell's score, less what rounding may change, is its floor; one block of its best cell comes first."""
        (a, b), (n, bucket, blocks) = held.value, layout.value
        for batch in batches:
            row, where = [], []
            floors = np.zeros(batch.num_rows)
            for i, m in enumerate(_matrix(batch.column("v"), dim)):
                left, right = a @ m[:half], b @ m[half:]
                if cells := cells_by_score(left, right, n, walk):
                    last, first = cells[-1], int(bucket[cells[0]])
                    floors[i] = left[last // len(b)] + right[last % len(b)] - 1e-9 * (np.abs(left).max() + np.abs(right).max())
                    places = sorted({(int(bucket[c]), s) for c in cells for s in range(int(blocks[c]))})
                    row += [i] * len(places)
                    where += [(t, s, (t, s) == (first, 0)) for t, s in places]
            for at in range(0, len(row), BLOCK):
                some = pa.array(row[at : at + BLOCK])
                to = np.array(where[at : at + BLOCK], np.int32).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(some), batch.column("v").take(some), pa.array(floors).take(some), pa.array(to[:, 0]), pa.array(to[:, 1]), pa.array(to[:, 2] > 0)],
                    ["query", "v", "floor", "bucket", "block", "first"],
                )

    n_queries = asking.count()
    parts = n_queries // queries_a_block + 1
    asked = asking.repartition(n_queries // WALKS + 1).mapInArrow(route, "query long, v array<double>, floor double, bucket int, block int, first boolean")
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")), "asked")
    per_cell = spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(counts), dtype=np.int32), "bucket": bucket, "blocks": blocks}), "cell int, bucket int, blocks long")
    entries = index.join(F.broadcast(per_cell), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    entries = entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else entries.withColumn("part", F.lit(0))

    def best(asking: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of each query among the entries of its own cells in one bucket."""
        columns = ([], [], [])
        if len(asking) and len(entry):
            a, b = held.value
            entry = entry.sort_values(["cell", "id"], kind="stable")
            ids, cell, m = entry["id"].to_numpy(), entry["cell"].to_numpy(), np.stack(entry["v"].to_numpy())
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            own = cell[starts]
            for at in range(0, len(asking), _TOGETHER):
                some = asking.iloc[at : at + _TOGETHER]
                q, v, floor, least = some["query"].to_numpy(), np.stack(some["v"].to_numpy()), some["floor"].to_numpy(), some["least"].to_numpy()
                walked = (v[:, :half] @ a.T)[:, own // len(b)] + (v[:, half:] @ b.T)[:, own % len(b)] >= floor[:, None]
                scores = np.full((len(q), len(ids)), -np.inf)
                for c, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)):
                    rows = np.flatnonzero(walked[:, c])
                    scores[rows, lo:hi] = _dot(v[rows], m[lo:hi])
                scores[(q[:, None] == ids[None, :]) | (scores < least[:, None])] = -np.inf
                row, column = nearest(ids, scores, k)
                for out, x in zip(columns, (q[row], ids[column], scores[row, column]), strict=True):
                    out.append(x)
        found = [np.concatenate(c) if c else np.zeros(0) for c in columns]
        return pd.DataFrame({"query_id": found[0].astype(np.int64), id_col: found[1].astype(np.int64), "score": found[2]})

    def searched(asked: DataFrame) -> DataFrame:
        group = ("bucket", "block", "part")
        return asked.groupBy(*group).cogroup(entries.groupBy(*group)).applyInPandas(best, f"query_id long, {id_col} long, score double")

    first = written(searched(asked.where("first").withColumn("least", F.lit(float("-inf")))), "first")
    # The k-th best so far; a query with fewer so far takes whatever comes.
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("query"), "least")
    rest = asked.where("not first").join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    found = first.unionByName(searched(rest))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id_col)).alias("rank")
    return found.select("query_id", rank, id_col, "score").where(F.col("rank") <= k)
