"""The words of texts as lists and as numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def word_lists(texts: pa.Array) -> tuple[list[bytes], list[list[bytes]], np.ndarray, np.ndarray]:
    """Each text in UTF-8 (a null one empty), its words `[^\\x20\\x09-\\x0D]+`, a number for each word that identical words alone share, and each text's first word (and the end)."""
    whole = [t.as_py() or b"" for t in texts.cast(pa.large_binary())]
    split = [t.split() for t in whole]  # on the six white-space bytes
    number: dict[bytes, int] = {}
    first = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    return whole, split, np.fromiter((number.setdefault(x, len(number)) for w in split for x in w), np.int64, int(first[-1])), first
