"""Word shingles of whole texts in numpy: ASCII lower case, words between white space, 64-bit hashes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
#: A random 64-bit number for each byte, odd multipliers for places in a word and in a shingle.
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = int(_rng.integers(0, 1 << 63)) * 2 + 1
_PLACE = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """_BASE to 0 .. n - 1 modulo 2^64, or its inverses."""
    key = "inverse" if inverse else "base"
    held = _powers.get(key)
    if held is None or len(held) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 23:
            _powers[key] = held
    return held[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[raw]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, stop)]))
    # A word is the sum of its bytes' numbers times powers of the base, counted from its start.
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(len(raw)), dtype=np.uint64)])
    value = (total[end] - total[start]) * _power(len(raw), True)[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), counts


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the size of each set.

    A shingle is k words in a row; a text of fewer words has one, all its words; a text without words has none.
    """
    words, counts = word_hashes(texts)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(counts) - counts
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    have = np.minimum(counts, k)[doc]
    value = have.astype(np.uint64)
    for j in range(k):
        on = j < have
        value = value + np.where(on, mix(words[np.minimum(at + j, max(len(words) - 1, 0))] + _PLACE[j]) * _PLACE[j + 32] if len(words) else np.uint64(0), np.uint64(0))
    value = mix(value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(texts)).astype(np.int64)
