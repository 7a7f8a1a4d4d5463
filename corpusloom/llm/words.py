"""Words, word shingles and their hashes, on whole texts as UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: Odd multipliers for the places in a shingle, and of the final mixing.
_PLACES = np.array([xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(64)], dtype=np.uint64)
_MIX = [np.uint64(xxhash.xxh3_64_intdigest(b"mix%d" % i) | 1) for i in range(2)]
#: Hashes of words that a worker keeps; beyond it starts anew.
_CACHE_WORDS = 50_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHash()


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text whose A-Z are lower-cased; bytes.lower() and bytes.split() know ASCII only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    if len(_hashes) > _CACHE_WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles; fewer words than `width` are one shingle; no words, none."""
    ws = words(text)
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(ws)
    k = min(width, len(ws))
    n = len(ws) - k + 1
    total = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        total += h[i : i + n] * _PLACES[i]
    total ^= total >> np.uint64(31)
    total *= _MIX[0]
    total ^= total >> np.uint64(29)
    return np.unique(total)
