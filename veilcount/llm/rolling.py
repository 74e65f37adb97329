"""Vectorised rolling hashes over symbol arrays (bytes or word hashes).

Helpers that run inside one task on one block of documents. A block holds the
symbols of many documents one after another; no hash or window ever crosses a
document's end.

* ``mix``          finaliser of a 64-bit value;
* ``Roller``       polynomial hashes of any span in constant time per span;
* ``select_seeds`` winnowing: the k-gram of least hash in every window.

All arithmetic is modulo 2**64. The multiplier is odd, so its powers have
inverses and a span's hash is a difference of two prefix sums times an inverse
power. Spans are hashed in two halves that are mixed before they are joined:
the low bits of a plain polynomial see only positions modulo a small power of
two.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow = {_BASE: np.ones(1, U), _INV: np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below n, kept for the next block of this worker."""
    have = _pow[base]
    while len(have) < n:
        step = U(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _pow[base] = have
    return have[:n]


class Roller:
    """Hashes of spans of one block's symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        self.inverse = powers(_INV, n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(symbols * powers(_BASE, n), out=self.sums[1:])

    def plain(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def span(self, start, end) -> np.ndarray:
        """Mixed hash of symbols[start:end]; start and end are arrays."""
        mid = start + (end - start) // 2
        head, tail = self.plain(start, mid), self.plain(mid, end)
        return mix(mix(head) * U(3) + mix(tail ^ U(0xD6E8FEB86659FD93)))

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of every run of k symbols."""
        m = max(0, self.n - k + 1)
        raw = (self.sums[k : k + m] - self.sums[:m]) * self.inverse[:m]
        return mix(raw)

    def windows(self, length: int, at: np.ndarray) -> np.ndarray:
        return self.span(at, at + length)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window, by block-wise running minima from both ends."""
    m = len(values) - width + 1
    if m <= 0:
        return values[:0]
    if width == 1:
        return values
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, ~U(0), U)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def window_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """True at each position where a window of this length lies in one document."""
    n = int(bounds[-1])
    ok = np.zeros(n + 1, np.int32)
    first, stop = bounds[:-1], bounds[1:] - length + 1
    keep = stop > first
    np.add.at(ok, first[keep], 1)
    np.add.at(ok, stop[keep], -1)
    return np.cumsum(ok[:-1]) > 0


def select_seeds(grams: np.ndarray, valid: np.ndarray, length: int, k: int):
    """Winnowing: (window starts, the seed that each window selects).

    Of the k-grams inside a window the one of least hash is its seed (the
    leftmost of equals), so that equal windows select equal seeds at equal
    offsets. A block has fewer than 2**26 symbols.
    """
    starts = np.flatnonzero(valid)
    if not len(starts):
        return starts, starts
    low = U((1 << 26) - 1)
    packed = (grams & ~low) | np.arange(len(grams), dtype=U)
    least = sliding_min(packed, length - k + 1)
    return starts, (least[starts] & low).astype(np.int64)
