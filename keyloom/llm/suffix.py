"""Fingerprints of byte strings at every position, and content-chosen anchors."""

from __future__ import annotations

import numpy as np

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM
_SEGMENT = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=_U) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, ``n`` at least; grown by doubling and kept."""
    for k, base in enumerate((_BASE, _INV)):
        while len(_POWERS[k]) < n:
            p = _POWERS[k]
            step = _U(pow(base, len(p), 1 << 64))
            _POWERS[k] = np.concatenate([p, p * step])
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Prints:
    """Fingerprints of any substring of one byte string, from one pass over it.

    ``sum(r[c_j] * base^j)`` over the string, shifted back to start at power 0,
    modulo 2^64, with random odd ``r`` per byte value and a finaliser on top.
    """

    def __init__(self, raw: bytes):
        self.raw = np.frombuffer(raw, np.uint8)
        self.n = len(self.raw)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(_BYTE[self.raw] * up[: self.n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))

    def grams(self, size: int) -> np.ndarray:
        """Of every substring of ``size`` bytes."""
        m = self.n - size + 1
        if m <= 0:
            return np.zeros(0, _U)
        return mix((self.sums[size:] - self.sums[:m]) * self.down[:m] + _U(size))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, m = 1, x
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1]) if size < w else m


def anchors(prints: Prints, gram: int = GRAM, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) of the grams that are least in some string of ``length`` bytes.

    Which gram that is depends on the string's bytes alone (the leftmost of
    equal ones), so two copies of a string have the same anchor at the same
    place, and a text shorter than ``length`` has none.
    """
    g = prints.grams(gram)
    w = length - gram + 1
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    found = []
    for lo in range(0, len(g) - w + 1, _SEGMENT - w):
        part = g[lo : lo + _SEGMENT]
        if len(part) < w:
            break
        ranked = (part & _U(0xFFFFFFFFFFF00000)) | np.arange(len(part), dtype=_U)
        least = _sliding_min(ranked, w)
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        found.append((least & _U(0xFFFFF)).astype(np.int64) + lo)
    pos = np.unique(np.concatenate(found))
    return pos, g[pos]
