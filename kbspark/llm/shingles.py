"""Sets of word shingles, as sorted 64-bit hashes, and their partition into segments."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # odd multipliers of a 64-bit finaliser
_S33 = np.uint64(33)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _C1
    x = (x ^ (x >> _S33)) * _C2
    return x ^ (x >> _S33)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Distinct ``k``-word shingles of ``text`` as sorted hashes. Words are runs
    of other bytes than ASCII white space, A-Z in lower case; fewer than ``k``
    words are one shingle, none are the empty set."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):  # words are hashed, so a polynomial of their hashes is enough
        h = h * _C1 + w[j : j + len(h)]
    return np.unique(mix(h))


def digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & _MASK) - (1 << 63)


@dataclass(frozen=True)
class Bands:
    """Size bands and segment counts for Jaccard similarity >= num / den.

    For sets of r and s elements that similarity allows a symmetric difference
    of at most (r + s) * (den - num) / (den + num) elements. A band's sets are
    cut into one more segments than the largest difference that it can meet,
    and some to spare: a similar pair then agrees wholly on several segments.
    """

    num: int
    den: int

    def reach(self, total: int) -> int:
        """The largest symmetric difference of similar sets of ``total`` elements together."""
        return (self.den - self.num) * total // (self.den + self.num)

    @lru_cache(maxsize=None)  # noqa: B019
    def upper(self, band: int) -> int:
        return 1 if band == 0 else max(self.upper(band - 1) + 1, self.upper(band - 1) * 3 // 2)

    @lru_cache(maxsize=None)  # noqa: B019
    def of_size(self, n: int) -> int:
        band = 0
        while self.upper(band) < n:
            band += 1
        return band

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, band: int) -> int:
        u = self.upper(band)
        least = self.reach(u + u * self.den // self.num) + 1
        return least + 1 + least // 8

    def indexed(self, n: int) -> bool:
        """Whether another set of at least as many elements can be similar."""
        return self.reach(n + n * self.den // self.num) > 0

    def probes(self, n: int) -> list[tuple[int, int]]:
        """(band, units needed) for the bands of sets no larger than ``n`` that can be similar."""
        own, out = self.of_size(n), []
        for band in range(own, -1, -1):
            if self.upper(band) * self.den < n * self.num:
                break
            if far := self.reach(n + min(n, self.upper(band))):
                out.append((band, far + 1))
        return out

    def segment_keys(self, s: np.ndarray, band: int, deep: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The keys of all segments of ``s``, and those of its first ``deep``
        segments with one element left out: (segment numbers, keys) of both."""
        m = self.segments(band)
        g = mix(s + np.uint64((band + 1) * int(_C2) & _MASK))
        of = ((g >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=m)
        sums = np.zeros(m, np.uint64)
        full = count > 0
        starts = np.concatenate(([0], np.cumsum(count)))[:-1]
        sums[full] = np.add.reduceat(g[order], starts[full])
        numbers = np.arange(m, dtype=np.uint64)
        base = mix(numbers * _C1 + np.uint64(band))
        keys = mix(sums + count.astype(np.uint64) * _C1 + base)
        some = np.flatnonzero(of < deep)
        short = mix(sums[of[some]] - g[some] + (count[of[some]] - 1).astype(np.uint64) * _C1 + base[of[some]])
        return numbers.astype(np.int64), keys.view(np.int64), of[some], short.view(np.int64)

    def sketch(self, s: np.ndarray, band: int) -> np.ndarray:
        """Parities of the numbers of elements that fall on each of 64 * k bits, k by
        the band. Two sets' sketches differ in no more bits than the sets in elements."""
        bits = 64
        while bits < self.upper(band):
            bits *= 2
        at = (mix(s ^ _C2) % np.uint64(bits)).astype(np.int64)
        return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)
