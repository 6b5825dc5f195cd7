"""Words of a text and 64-bit hashes of their k-grams, in numpy.

A word is a longest run of ASCII letters, digits and characters beyond ASCII, with
A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

_KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Words hashed at a time, so that very long texts need bounded memory.
_CHUNK = 1 << 15

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def words_of(text: str | None) -> list[bytes]:
    """Null and empty texts have no words."""
    return text.encode("utf-8", "replace").translate(_KEEP).split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose order is unlike the order put in."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _sums(joined: bytes) -> np.ndarray:
    """Running sums from which the hash of any stretch follows."""
    up = _grown(len(joined) + 1)[0]
    sums = np.empty(len(joined) + 1, np.uint64)
    sums[0] = 0
    codes = np.frombuffer(joined, np.uint8).astype(np.uint64)
    codes += np.uint64(1)
    codes *= up[: len(joined)]
    np.cumsum(codes, out=sums[1:])
    return sums


def hashes(words: list[bytes], sizes: tuple[int, ...], begin: int = 0) -> list[np.ndarray]:
    """For each size k the hash of every run of k words, in order; last, if begin, the hash of
    each word's first `begin` bytes, 0 for shorter words.
    """
    out: list[list[np.ndarray]] = [[] for _ in range(len(sizes) + bool(begin))]
    overlap = max(sizes, default=1) - 1
    for at in range(0, len(words), _CHUNK):
        joined = b" ".join(words[at : at + _CHUNK + overlap])
        sums, down = _sums(joined), _grown(len(joined) + 1)[1]
        ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
        starts = np.append(0, ends[:-1] + 1)
        for kept, k in zip(out, sizes, strict=False):
            n = min(_CHUNK, len(ends) - k + 1)
            if n > 0 and k > 0:
                a, z = starts[:n], ends[k - 1 : k - 1 + n]
                kept.append(mix((sums[z] - sums[a]) * down[a]))
        if begin:
            a, z = starts[:_CHUNK], ends[:_CHUNK]
            h = mix((sums[np.minimum(a + begin, z)] - sums[a]) * down[a])
            h[z - a < begin] = 0
            out[-1].append(h)
    return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.empty(0, np.uint64) for x in out]


def kgrams(words: list[bytes], k: int) -> np.ndarray:
    """Hash of every run of k words, in order; empty if there are fewer words."""
    return hashes(words, (k,))[0]


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word runs; a text of fewer words, but not none, is one run."""
    return distinct(kgrams(words, min(k, len(words))))
