"""Hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from tunegrain.llm.fingerprints import mix

WORDS = 5
# A worker's memory of word hashes is emptied beyond this many.
KNOWN_WORDS = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sets of shingle hashes: words are runs without ASCII white space, A-Z lower-cased.

    A text of fewer words than a shingle has its whole sequence as the only one; a text without
    words has none.
    """

    def __init__(self, words: int = WORDS):
        self._words = words
        self._hashes = _Hashes()
        self._factors = mix(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the sorted distinct hashes."""
        known, k = self._hashes.__getitem__, self._words
        hashes: list[int] = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(hashes)
            if text:
                hashes.extend(map(known, text.encode().lower().split()))
            counts[i] = len(hashes) - before
        words = np.fromiter(hashes, np.uint64, len(hashes))
        if len(self._hashes) > KNOWN_WORDS:
            self._hashes.clear()
        full = max(0, len(words) - k + 1)
        joined = np.zeros(full, np.uint64)
        for j in range(k):
            joined += words[j: j + full] * self._factors[j]
        joined = mix(joined)
        out, start = [], 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(joined[start: start + n - k + 1]))
            elif n:
                short = (words[start: start + n] * self._factors[:n]).sum() + np.uint64(n)
                out.append(mix(np.array([short])))
            else:
                out.append(np.zeros(0, np.uint64))
            start += n
        return out
