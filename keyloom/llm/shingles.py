"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

from keyloom.llm.common import memo

WORDS = 5
_U = np.uint64
_MEMO = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


class _Hashes(dict):
    """64-bit hash of each word, kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
memo("shingles", _HASHES.clear)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles.

    A-Z are lower-cased, words are runs of anything but ASCII white space; a
    text of fewer than ``WORDS`` words is one shingle, one without words none.
    """
    if not text:
        return np.zeros(0, _U)
    words = text.encode().translate(_LOWER).split()  # bytes.split: ASCII white space
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], _U) if n else np.zeros(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U, n)
    m = n - WORDS + 1
    s = np.zeros(m, _U)
    for k in range(WORDS):
        s = (s ^ (h[k : k + m] * _MULT[k])) * _U(0xFF51AFD7ED558CCD) + _U(k)
    s = np.sort(mix(s))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]
