"""Pair merging for byte-pair vocabularies: the contiguous rank array, and a heap for long pieces of text."""

from __future__ import annotations

import heapq
from collections.abc import Callable

#: Pieces of more parts than this go by the heap, whose time grows with n log n; the results are the same.
SHORT = 128
_NONE = float("inf")


def merged(parts: list[str], rank: dict[str, float], between: str = "") -> list[str]:
    """parts after every merge that rank allows, lowest rank first and leftmost among equals; rank's keys are the two parts with `between` between them."""
    return _scanned(parts, rank, between) if len(parts) <= SHORT else _heaped(parts, rank, between)


def _scanned(parts: list[str], rank: dict[str, float], between: str) -> list[str]:
    get = rank.get
    ranks = [get(a + between + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks and (least := min(ranks)) != _NONE:
        i = ranks.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] + between + parts[i], _NONE)
        if i < len(ranks):
            ranks[i] = get(parts[i] + between + parts[i + 1], _NONE)
    return parts


def _heaped(parts: list[str], rank: dict[str, float], between: str) -> list[str]:
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    held: list[str | None] = list(parts)
    heap: list[tuple[float, int, str, str]] = []

    def offer(i: int) -> None:
        if 0 <= i and after[i] < n and (r := rank.get(held[i] + between + held[after[i]])) is not None:
            heapq.heappush(heap, (r, i, held[i], held[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if held[i] != a or after[i] >= n or held[j := after[i]] != b:
            continue
        held[i], held[j] = a + b, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [x for x in held if x is not None]


class Remembered(dict):
    """A bounded memory of a function of words, cleared when it is full, so that it changes the time but never a result."""

    def __init__(self, of: Callable, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.of(word)
        return value
