"""Word hashes that workers keep for the words met lately."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 200_000


class _Known(dict):
    """Hashes by word; an unknown word is hashed and kept."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h


class WordHasher:
    """64-bit hashes of words; the memory is bounded and no result depends on it."""

    def __init__(self, seed: int = 7):
        self.known = _Known(seed)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > MEMO:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
