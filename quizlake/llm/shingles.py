"""Vectorised shingle hashing and MinHash signatures, for the operators on near copies and licences."""

from __future__ import annotations

import numpy as np
import xxhash

_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _C[3]
    return (x ^ (x >> np.uint64(29))) * _C[4] ^ (x >> np.uint64(17))


def joined(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes (uint64) of each run of ``n`` tokens; shorter by n - 1 than the input, empty if that is shorter."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * _C[1] + tokens[k : k + m] * _C[k % 8]
    return mix(h)


def word_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes; a text shorter than ``n`` words is one shingle, an empty one has none."""
    return np.unique(joined(words, n if len(words) >= n else max(1, len(words))))


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, k, dtype=np.uint32), rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1)


def signatures(flat: np.ndarray, starts: np.ndarray, k: int, seed: int) -> np.ndarray:
    """MinHash signatures, (number of sets, k) uint32. ``flat``: the sets' hashes one after another (uint64); ``starts``: where each, non-empty, begins."""
    low, (xor, mul) = (flat >> np.uint64(32)).astype(np.uint32), permutations(k, seed)
    out, room = np.empty((k, len(starts)), dtype=np.uint32), np.empty_like(low)
    for i in range(k):
        np.bitwise_xor(low, xor[i], out=room)
        np.multiply(room, mul[i], out=room)
        np.minimum.reduceat(room, starts, out=out[i])
    return out.T


def band_key(columns: list[np.ndarray], band: int) -> np.ndarray:
    """64-bit keys (int64) of one band from its signature columns; the band's number is part of the key."""
    h = np.full(len(columns[0]), band + 1, dtype=np.uint64) * _C[5]
    for r, c in enumerate(columns):
        h = (h ^ (h >> np.uint64(31))) + c.astype(np.uint64) * _C[r % 8]
    return mix(h).view(np.int64)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The keys of all bands of signatures, (n, bands) int64."""
    return np.stack([band_key([sig[:, b * rows + r] for r in range(rows)], b) for b in range(bands)], axis=1)
