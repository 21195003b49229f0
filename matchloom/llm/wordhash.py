"""64-bit hashes of the words of a text, without a step per word.

A word's hash is the polynomial of its bytes' random values, taken from prefix
sums over the whole text and brought to the power of the word's start, then mixed.
"""

from __future__ import annotations

import numpy as np

#: Bytes handled at once; a word that is longer than that makes the tables of powers longer.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SMALL = _EXACT.copy()
_SMALL[65:91] = _EXACT[97:123]
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _tables.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, BLOCK), np.uint64)
        size = 1
        while size < len(known):
            more = min(size, len(known) - size)
            known[size : size + more] = known[:more] * np.uint64(pow(base, size, 1 << 64))
            size *= 2
        _tables[base] = known
    return known


def words(raw: bytes, lower: bool = False, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a text, runs of bytes that are no gap; ``lower``: A-Z count as a-z."""
    x = np.frombuffer(raw, np.uint8)
    between = np.ones(len(x) + 2, bool)
    between[1:-1] = gap[x]
    edge = np.flatnonzero(between[1:] != between[:-1])
    start, end = edge[::2], edge[1::2]
    values = _SMALL if lower else _EXACT
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
        a, b = int(start[at]), int(end[upto - 1])
        total = np.empty(b - a + 1, np.uint64)
        total[0] = 0
        np.cumsum(values[x[a:b]] * _powers(_BASE, b - a)[: b - a], out=total[1:])
        first, last = start[at:upto] - a, end[at:upto] - a
        out[at:upto] = (total[last] - total[first]) * _powers(_INVERSE, b - a)[first] + (last - first).astype(np.uint64)
        at = upto
    return mix(out), start, end
