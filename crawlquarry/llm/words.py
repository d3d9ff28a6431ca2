"""Words and word shingles as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Letters and digits; \w without the underscore.
WORD = re.compile(r"[^\W_]+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Memo from word to its 64-bit hash; emptied when it has grown past ``most`` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) > self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts, width: int, memo: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, index of the text of each, words of each text); None counts as no words.

    A text of fewer than ``width`` words has no shingle.
    """
    hashed, counts = [], np.zeros(len(texts), np.int64)
    of = memo.__getitem__
    for i, text in enumerate(texts):
        if text:
            found = WORD.findall(text.lower())
            counts[i] = len(found)
            hashed.extend(map(of, found))
    w = np.array(hashed, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(w) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), counts
    n = len(w) - width + 1
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s = mix(s + w[k : k + n] + _GOLD)
    whole = owner[:n] == owner[width - 1 :]
    return s[whole], owner[:n][whole], counts


def unique_by_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner, then value."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    if not len(v):
        return v, o
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[new], o[new]
