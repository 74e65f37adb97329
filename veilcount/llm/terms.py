"""Hashed terms of texts, for the classifiers that learn from words."""

from __future__ import annotations

import numpy as np

from .rolling import Roller, U, mix

_codes = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
SLICE = 1 << 17
#: Bytes of words: digits, letters of either case, and all of longer characters.
_inner = np.zeros(256, bool)
_inner[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_filled = np.ones(256, bool)
_filled[[0x20, *range(0x09, 0x0E)]] = False


def slices(text: np.ndarray, inner: np.ndarray):
    """(bytes, first byte and end of every word) for parts of bounded size."""
    edge = np.zeros(len(text) + 2, bool)
    edge[1:-1] = inner[text]
    start, end = np.flatnonzero(edge[1:] & ~edge[:-1]), np.flatnonzero(~edge[1:] & edge[:-1])
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, side="right")))
        low = start[i]
        yield text[low : end[j - 1]], start[i:j] - low, end[i:j] - low
        i = j


def distinct_terms(text: np.ndarray, dims: int, prefix: int = 0, split_marks: bool = True) -> np.ndarray:
    """Sorted hashed terms of one text: its words, and with ``prefix`` their first bytes too.

    With ``split_marks`` words are letters and digits only, else everything
    between white space.
    """
    found = []
    for part, start, end in slices(text, _inner if split_marks else _filled):
        roller = Roller(_codes[part])
        found.append(roller.span(start, end))
        if prefix:
            long = end - start > prefix
            found.append(mix(roller.span(start[long], start[long] + prefix) ^ U(0xA5A5)))
    if not found:
        return np.zeros(0, np.int64)
    ids = np.sort((np.concatenate(found) % U(dims)).astype(np.int64))
    return ids[np.append(True, ids[1:] != ids[:-1])]


class Sparse:
    """Rows of hashed terms: ``ids[at[i]:at[i + 1]]`` are those of row i."""

    def __init__(self, rows: list[np.ndarray]):
        self.at = np.cumsum([0, *map(len, rows)])
        self.ids = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row number within ``rows``, term) of the given rows."""
        size = self.at[rows + 1] - self.at[rows]
        skip = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(np.arange(len(rows)), size), self.ids[np.repeat(self.at[rows], size) + skip]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
