"""Word shingles as sorted 64-bit hashes, and one-permutation MinHash sketches of them.

All functions are NumPy over one text or one set; the Spark side is in ``minhash_dedup``.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _CHUNK + 1), _powers(_INVERSE, _CHUNK + 1)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, in order.

    A word's hash is a polynomial over its UTF-8 bytes, taken from running sums, so no Python loop
    visits the words. Texts are worked through in pieces of a bounded number of bytes cut at blanks;
    a single word longer than a piece is hashed by itself.
    """
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:
                later = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashes(data: np.ndarray) -> np.ndarray:
    if len(data) > _CHUNK:
        up, down = _powers(_BASE, len(data) + 1), _powers(_INVERSE, len(data) + 1)
    else:
        up, down = _UP, _DOWN
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    edge = np.diff(inside)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles.

    A text of fewer than ``size`` words is one shingle, a text without words (or null) none.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        out = mix(out * _BASE + words[i : i + n])
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))


def similar(n_a: int, n_b: int, common: int, percent: int) -> bool:
    """``100 * intersection >= percent * union`` in whole numbers; empty sets are similar to nothing."""
    return common > 0 and 100 * common >= percent * (n_a + n_b - common)


class OnePermutation:
    """One-permutation MinHash: the hash range is cut into bins, each keeps its smallest value.

    An empty bin takes the value of a bin that a fixed random sequence of its own leads to, the first
    that is not empty (optimal densification), so that equal bins stay as likely as the sets' similarity.
    """

    def __init__(self, bands: int = 24, rows: int = 5):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        tries = np.arange(self.bins * 512, dtype=np.uint64)
        self.walk = (mix(tries + np.uint64(0x5BD1E995)) % np.uint64(self.bins)).astype(np.int64).reshape(self.bins, 512)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Values of the bins; ``hashes`` is a set that is not empty."""
        place = (((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)).astype(np.int64)
        value = mix(hashes)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        out = np.full(self.bins, top, np.uint64)
        np.minimum.at(out, place, value)
        filled = np.zeros(self.bins, bool)
        filled[place] = True
        empty = np.flatnonzero(~filled)
        if len(empty):
            reached = filled[self.walk[empty]]
            first = reached.argmax(axis=1)
            source = self.walk[empty, first]
            stuck = ~reached.any(axis=1)  # a walk that met no filled bin: take the next one upwards
            if stuck.any():
                some = np.flatnonzero(filled)
                source[stuck] = some[np.searchsorted(some, empty[stuck]) % len(some)]
            out[empty] = out[source]
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """One 64-bit key per band, over the band's bins."""
        grid = signature.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            key = mix(key * _BASE + grid[:, i])
        return key
