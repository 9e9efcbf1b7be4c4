"""BPE encoding and decoding of whole texts with a byte-level vocabulary in the tokenizers library's JSON format.

Each pre-token is merged on a contiguous rank array: the word's parts and the ranks of neighbouring parts lie in two
lists; the least rank is found by scanning, its boundary deleted, and the ranks beside it refreshed.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import Remembered, merged
from .shipping import ship
from .wordhash import carried, pieces

#: The pre-token pattern of byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers at most.
REMEMBER = 250_000


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    stands = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}
    return [stands[b] for b in range(256)]


class ByteBPE:
    """encode() and decode() as the tokenizers library does them without added special tokens; special strings that stand in a text become their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.rank = {a if isinstance(a, str) else " ".join(a): float(i) for i, a in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        stands = _byte_characters()
        self.stands = stands
        byte = {c: b for b, c in enumerate(stands)}
        names = {i: t for t, i in self.vocab.items()}
        self.bytes = {i: bytes(byte[c] for c in t) for i, t in names.items()} | {i: t.encode() for t, i in self.special.items()}
        self.find = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Remembered(self._word, REMEMBER)

    def _word(self, word: str) -> bytes:
        parts = merged([self.stands[b] for b in word.encode()], self.rank, " ")
        return array("I", [self.vocab[p] for p in parts]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        word = self.words.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(word, self.find(text)))
        out = []
        for part in self.cut.split(text):
            out += [array("I", [self.special[part]]).tobytes()] if part in self.special else map(word, self.find(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


@lru_cache(2)
def _model(path: str) -> ByteBPE:
    return ByteBPE(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        model = _model(path)
        for batch in pieces(batches, size=2 << 20):
            packed = [model.encode(t or "") for t in batch.column("text").to_pylist()]
            yield batch, [pa.array(packed, pa.binary()), pa.array(map(model.decode, packed), pa.string())]

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, the columns of keep, ids (binary: the token ids as little-endian unsigned 32-bit
    integers), decoded (string: the text that these ids decode to).

    path: the vocabulary file, readable on every executor. A null text counts as empty: no ids, an empty decoded text. A
    null id stays null; repeated rows come out as often as they came in; columns not named are ignored. A very long
    pre-token is merged by a heap with the same result, so its time grows with n log n.
    """
    ship(docs.sparkSession)
    return carried(docs, id_col, text_col, keep, _run(path), "ids binary, decoded string")


def ids_array(ids):
    """A binary ids column as array<long>."""
    n = F.shiftright(F.octet_length(ids), 2)
    number = lambda i: sum(
        (F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("long") * 256**k for k in range(4)), F.lit(0)
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<long>"))
