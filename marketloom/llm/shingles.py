"""Word hashes, hashed word n-grams and MinHash signatures of batches of texts (numpy, inside tasks)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words as bytes; forgets all when it holds ``most`` words."""

    def __init__(self, seed: int = 0, most: int = 300_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space, in UTF-8. None has no words."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of every ``n`` consecutive values, modulo 2**64."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * MIX + hashes[k : k + len(out)]
    return out


def shingle_set(text: str | None, n: int, memo: WordHashes) -> np.ndarray:
    """The sorted set of hashed word ``n``-grams; a text of 1 to ``n - 1`` words is one n-gram."""
    hashes = memo.of(split_words(text))
    return np.unique(mixed(rolling(hashes, min(n, len(hashes))))) if len(hashes) else hashes


def chosen_bands(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """Bands and rows a band: the longest bands with which at most ``most`` hash functions find a pair of
    similarity ``threshold`` with probability ``recall`` at least."""
    for rows in range(most, 0, -1):
        hit = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-hit)) if hit < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches this recall")


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> Iterator[np.ndarray]:
    """For every non-empty set its ``bands`` MinHash band hashes, which differ from band to band."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    at, room = 0, 32_768
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= room):
            size += len(sets[end])
            end += 1
        every = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        least = np.empty((bands * rows, end - at), np.uint64)
        for k in range(bands * rows):
            least[k] = np.minimum.reduceat((every ^ x[k]) * a[k], starts)
        out = np.empty((end - at, bands), np.uint64)
        for b in range(bands):
            h = np.full(end - at, b + 1, np.uint64)
            for k in range(rows):
                h = mixed(h * MIX + least[b * rows + k])
            out[:, b] = h
        yield from out
        at = end


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
