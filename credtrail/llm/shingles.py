"""Words and word shingles of whole texts, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from credtrail.llm.common import Cached, mixed

SHINGLE_WORDS = 5
STEP = np.uint64(0x9FB21C651E98DF25)


def word_hashes() -> Cached:
    return Cached(xxhash.xxh3_64_intdigest, 300_000)


def shingle_set(text: str | None, known: Cached, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z in lower case; the whole
    sequence as one if it is shorter; empty without words."""
    if not text:
        return np.empty(0, np.uint64)
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(words, len(h))
    runs = len(h) - n + 1
    total = h[:runs].copy()
    for i in range(1, n):
        total = total * STEP + h[i : runs + i]
    return np.unique(mixed(total + np.uint64(n)))
