"""Content-defined anchors of byte windows, vectorised over a batch of texts.

Every window of ``length`` bytes is given one anchor: the position of the smallest
8-byte hash among its first ``width`` positions (leftmost on ties).  The choice looks
at the window's own bytes alone, so equal windows, wherever they stand, have equal
anchors at equal offsets, and the ``length - width + 1`` bytes from the anchor on
(the *core*) are equal too.  Consecutive windows mostly share their anchor, so a text
of ``n`` bytes has about ``2 n / width`` anchors instead of ``n`` windows.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words64(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one word; zeros stand past the end."""
    x = np.zeros(len(data) + 7, dtype=np.uint64)
    x[: len(data)] = data
    for step in (1, 2, 4):
        x = x[: len(x) - step] | (x[step:] << np.uint64(8 * step))
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64; kept from call to call."""
    out = _POWERS.get(base)
    if out is None or len(out) < n:
        out = _POWERS[base] = _more_powers(base, max(n, 1 << 16))
    return out[:n]


def _more_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step % (1 << 64)
    return out[:n] if n else out[:0]


class RangeHash:
    """Polynomial hashes modulo 2**64 of any ranges of a byte buffer, after one pass."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self._sums[1:])
        self._inverse = _powers(_BASE_INV, n + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        value = (self._sums[stop] - self._sums[start]) * self._inverse[start]
        return mix64(value + (stop - start).astype(np.uint64) * _MIX)


def sliding_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash among ``width`` from each position on, leftmost on ties.

    ``key`` holds 32-bit hashes in a 64-bit array; the result has ``len(key) - width + 1`` places.
    """
    low = (key << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        rest = width - span
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def window_anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, width: int):
    """Runs of windows with one anchor in each text of a concatenated buffer.

    Returns ``(text, lo, hi, anchor)``: window starts ``lo..hi`` (positions in the buffer, both
    included) of text number ``text`` share ``anchor``.  Texts under ``length`` bytes have none.
    """
    empty = np.empty(0, dtype=np.int64)
    if len(data) < length or not (sizes >= length).any():
        return empty, empty, empty, empty
    key = mix64(words64(data) * _MIX) >> np.uint64(32)
    pick = sliding_argmin(key, width)
    count = np.maximum(sizes - length + 1, 0)
    has = count > 0
    text = np.flatnonzero(has)
    valid = np.zeros(len(pick) + 1, dtype=np.int8)
    np.add.at(valid, starts[has], 1)
    np.add.at(valid, np.minimum(starts[has] + count[has], len(pick)), -1)
    inside = np.cumsum(valid[:-1]) > 0
    pos = np.flatnonzero(inside)
    a = pick[pos]
    cut = np.ones(len(pos), dtype=bool)
    cut[1:] = (a[1:] != a[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(cut)
    lo = pos[first]
    hi = pos[np.append(first[1:] - 1, len(pos) - 1)]
    owner = text[np.searchsorted(starts[has], lo, side="right") - 1]
    return owner, lo, hi, a[first]
