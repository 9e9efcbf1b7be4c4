"""Token counts under a sentencepiece BPE model with byte fallback, by the whole-token shortcut.

No vocabulary string holds a space mark after another character, so merges never cross from a word into the mark before
the next one, and a text falls into pre-tokens (space marks and what follows them) that are counted on their own. Before
any text is read, every vocabulary string is encoded alone: those that come out as one token are the whole tokens. A
pre-token that is one of them counts as 1 directly; only the rest is merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import Remembered, merged
from .shipping import ship
from .wordhash import pieces

MARK = "▁"
#: Pre-tokens whose counts a worker remembers at most.
REMEMBER = 500_000


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        plain = [i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("a vocabulary string spans two words: texts can't be counted by pre-token")
        if not all(model.is_byte(i) for i in map(model.piece_to_id, (f"<0x{b:02X}>" for b in range(256)))):
            raise ValueError("the model has no byte fallback")
        self.whole = frozenset(p for p in self.rank if re.fullmatch(f"{MARK}+[^{MARK}]*|[^{MARK}]+", p) and self._merge(p) == 1)
        self.words = Remembered(self._count, REMEMBER)

    def _merge(self, pre_token: str) -> int:
        return sum(1 if p in self.rank else len(p.encode()) for p in merged(list(pre_token), self.rank))

    def _count(self, word: str) -> int:
        """Of the pre-token of one space mark and word."""
        return self.pre_token(MARK + word)

    def pre_token(self, pre_token: str) -> int:
        return 1 if pre_token in self.whole else self._merge(pre_token)

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(" ", MARK).split(MARK)
        if "" not in words:
            return sum(map(self.words.__getitem__, words))
        return sum(map(self.pre_token, re.findall(f"{MARK}+[^{MARK}]*", MARK + MARK.join(words))))


@lru_cache(2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(counter.count, texts), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes (UTF-8), n_tokens, without begin and end tokens.

    path: the model file, readable on every executor. A null text counts as empty: 0 bytes, 0 tokens. A null id stays null;
    repeated rows come out as often as they came in; other columns of docs are ignored. A very long pre-token is merged by
    a heap with the same result.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_run(path), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
