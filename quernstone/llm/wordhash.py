"""Words, word triples and minimum-hash symbols of whole Arrow batches, computed with numpy over one flat word array."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text; none for null."""
    return WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound so that a worker's memory stays flat."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S29)) * _M2
    return (x ^ (x >> _S32)) * _M3


def flat_hashes(lists: list[list[str]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in one array, and each text's number of words."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    get = cache.__getitem__
    return np.fromiter((get(w) for ws in lists for w in ws), np.uint64, int(counts.sum())), counts


def runs(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of `size` consecutive words inside one text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))
    start = np.flatnonzero(left >= size)
    value = np.zeros(len(start), np.uint64)
    for k in range(size):
        value = mix(value * _M1 + hashes[start + k])
    return owner[start], value


def distinct_runs(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As runs(), each run once per text, ordered by text and hash."""
    owner, value = runs(hashes, counts, size)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def min_symbols(owner: np.ndarray, value: np.ndarray, n_texts: int, n_symbols: int, modulus: int) -> np.ndarray:
    """n_texts x n_symbols matrix: symbol s names the run whose s-th hash is least. Rows of texts without runs hold -1."""
    out = np.full((n_texts, n_symbols), -1, np.int64)
    if len(owner):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        for s in range(n_symbols):
            least = np.minimum.reduceat(mix(value ^ np.uint64((s + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF)), starts)
            out[owner[starts], s] = (mix(least ^ _M3) >> np.uint64(33)).astype(np.int64) % modulus
    return out
