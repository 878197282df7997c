"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0x94D049BB133111EB)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for the next call."""
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        known = np.ones(max(n, 1 << 16), np.uint64)
        known[1:] = base % 2**64
        np.multiply.accumulate(known, out=known)
        _POWERS[name] = known
    return known[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter; none without words.

    Words are cut and A-Z lower-cased on UTF-8 bytes, where both are single
    bytes. A word's hash is a polynomial over its bytes, from one running sum
    over the text.
    """
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers("up", _BASE, len(data)), out=sums[1:])
    words = _mixed((sums[end] - sums[begin]) * _powers("down", pow(_BASE, -1, 2**64), len(data))[begin])
    if len(words) <= width:
        total = words[:1].copy()
        for w in words[1:]:
            total = total * _STEP + w
        total += np.uint64(len(words))  # a short sequence is not the start of a long one
    else:
        last = len(words) - width + 1
        total = words[:last].copy()
        for k in range(1, width):
            total = total * _STEP + words[k:last + k]
        total += np.uint64(width)
    return np.unique(_mixed(total))
