"""Words and shingles of Arrow text columns as 64-bit numbers, without a Python object per word.

A word's number depends on its (lower-cased) bytes alone, so every task gives the same word the same number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and of everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, step in enumerate((_STEP, _STEP_INVERSE)):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """The words of some texts: data holds their bytes, word i is data[start[i]:end[i]], text d has words first[d]:first[d + 1]."""

    def __init__(self, texts: pa.Array, kind: np.ndarray):
        texts = texts.fill_null("") if texts.null_count else texts
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        self.data = whole[offsets[0] : offsets[-1]]
        inside = kind[self.data]
        edge = np.zeros(len(self.data) + 1, bool)  # where a text begins
        edge[self.bounds] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.bounds)

    def numbers(self) -> np.ndarray:
        n = len(self.data)
        power, inverse = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[_LOWER[self.data]] * power, out=total[1:])
        value = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * _MULT)


def shingles(numbers: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the numbers of its runs of width words, in order and with repeats; a shorter text gives its whole sequence as one, an empty one none."""
    with np.errstate(over="ignore"):
        factor = mix(np.arange(1, width + 1, dtype=np.uint64) * _MULT) | np.uint64(1)
        n = len(numbers)
        run = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            run += numbers[k : k + len(run)] * factor[k]
        run = mix(run + np.uint64(width))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield run[a : b - width + 1]
            elif b > a:
                yield mix(np.array([(numbers[a:b] * factor[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield numbers[:0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about so many bytes of text, so that memory follows one run; a longer text makes a run of its own."""
    for batch in batches:
        texts = batch.column(column)
        lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        at, rows, total = 0, len(lengths), np.concatenate([[0], np.cumsum(lengths)])
        while at < rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def carried(docs, id_col: str, text_col: str, keep: tuple[str, ...], run, made: str):
    """docs' id, text and keep columns through run in Arrow batches; the result has id_col, the keep columns, and those that `made` declares.

    run gives, for an iterator of batches (id, text, ...), the batch and the arrays made of it.
    """
    from pyspark.sql import functions as F

    kept = [f"kept_{i}" for i in range(len(keep))]
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    names = [part.split()[0] for part in made.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in run(source):
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(k) for k in kept), *arrays], ["id", *kept, *(f"made_{n}" for n in names)])

    types = {f.name: f.dataType.simpleString() for f in d.schema}
    schema = ", ".join([f"id {types['id']}", *(f"{k} {types[k]}" for k in kept), *(f"made_{part}" for part in made.split(", "))])
    out = d.mapInArrow(batches, schema)
    return out.select(F.col("id").alias(id_col), *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), *(F.col(f"made_{n}").alias(n) for n in names))
