"""Word shingles of texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a worker remembers.
REMEMBERED = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    values = (values ^ (values >> np.uint64(30))) * _M1
    values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words: A-Z lower-cased, split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(hashes) - width + 1
    value = mix(hashes[:n] + np.uint64(width))
    for step in range(1, width):
        value = mix(value * np.uint64(3) + hashes[step : step + n])
    return value


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles; a text of fewer words, but not none, is one shingle."""
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    return np.unique(sequence_hashes(hashes, min(width, len(hashes))))
