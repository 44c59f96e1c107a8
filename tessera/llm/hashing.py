"""64-bit hashes of bytes, words and sliding strings, the same in every process.

Spans are quick and can collide by construction: they choose and group, and what they group is compared by its bytes.
digest() and WordDigests are of BLAKE2b: different words or strings are taken as equal with a chance of 2 ** -64 a pair
(2 ** -128 for digest), whatever they look like.
"""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, so that sums of powers do not see the bytes themselves.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        p = np.full(size + 1, base, np.uint64)
        p[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(p)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of any spans of one buffer by prefix sums: equal bytes, equal hash, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(n)[:n], out=self.sums[1:])
        self.back = powers(n, _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def digest(data: bytes) -> bytes:
    """128 bits."""
    return hashlib.blake2b(data, digest_size=16).digest()


class WordDigests(dict):
    """64 bits of a word's BLAKE2b; short words are remembered, up to a bound.

    Workers live on between stages, so the bound (about 6 MB) is what this costs all of them.
    """

    ROOM = 1 << 15
    LONGEST = 64

    def __missing__(self, word: bytes) -> int:
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8, person=b"tessera-word").digest(), "little")
        if len(word) <= self.LONGEST:
            if len(self) >= self.ROOM:
                self.clear()
            self[word] = got
        return got


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links x-y, the least node of each node's component."""
    lab = np.arange(n)
    while len(x):
        low = np.minimum(lab[x], lab[y])
        np.minimum.at(lab, lab[x], low)
        np.minimum.at(lab, lab[y], low)
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
        apart = lab[x] != lab[y]
        x, y = x[apart], y[apart]
    return lab
