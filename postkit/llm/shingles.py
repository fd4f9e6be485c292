"""Hashed word shingles of texts, computed with array operations over the bytes of a text."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value for every byte; words are runs of word bytes after A-Z are lower-cased.
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * (out[done - 1:done] * base)
        done += more
    return out


def word_hashes(data: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text, in order."""
    if not data:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data.lower(), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _IS_WORD[b]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    powers = _powers(_BASE, int(lengths.max()))
    at = np.flatnonzero(inside[1:-1])                        # positions of word bytes
    first = np.cumsum(lengths) - lengths                     # of each word among them
    within = np.arange(len(at)) - np.repeat(first, lengths)
    return mix(np.add.reduceat(_BYTE[b[at]] * powers[within], first) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; fewer words, but not none, are one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = out * _STEP + words[k:k + n]
    return mix(out)
