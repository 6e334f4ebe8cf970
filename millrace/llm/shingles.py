"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

P1, P2, P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * P2
    h = (h ^ (h >> np.uint64(27))) * P3
    return h ^ (h >> np.uint64(31))


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` turns A-Z, and nothing else, to lower case."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return data.lower().split() if lower else data.split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words; the empty array if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    # doubling: h[k] covers 2^k words, and the width's binary digits are put together
    out, covered, block, size = None, 0, words, 1
    left = width
    while left:
        if left & 1:
            part = block[covered : covered + n]
            out = part if out is None else mix(out * P1 + part)
            covered += size
        left >>= 1
        if left:
            block = mix(block[:-size] * P1 + block[size:] + np.uint64(size))
            size *= 2
    return mix(out + np.uint64(width))


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` make one shingle, no words none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(width, len(words))))
