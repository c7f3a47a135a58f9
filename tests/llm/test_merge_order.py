"""The merge's orders: one sort of packed words, equal to the stable order by all keys, and what it finds in several shards."""

import random
from collections import Counter

import numpy as np
import pytest

from webdelta.llm import suffix_dedup


def test_in_turn_is_the_stable_order():
    rng = np.random.default_rng(1)
    for n, tops in ((0, (5,)), (1, (1, 1)), (5000, (7,)), (5000, (3, 1 << 30)), (5000, (1 << 40, 3)), (300, (1 << 62, 1 << 62))):
        keys = [rng.integers(0, top, n) for top in tops]
        assert suffix_dedup.in_turn(*keys).tolist() == np.lexsort(keys[::-1]).tolist()


@pytest.mark.parametrize("length", [8, 12, 67])
def test_the_merge_sorts_by_packed_words(monkeypatch, length):
    rng = random.Random(length)
    base = bytes(rng.choice(b"abcd") for _ in range(400))
    pieces = []
    for _ in range(60):
        a = rng.randint(0, 300)
        pieces.append(base[a : a + rng.randint(0, 120)] + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))))
    seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in pieces]
    monkeypatch.setattr(suffix_dedup, "SHARD", 500)
    assert [x.tolist() for x in suffix_dedup.repeated_windows(pieces, length)] == want and any(want)

    def slow(*args, **how):
        raise AssertionError("sorted by one key after the other")

    monkeypatch.setattr(np, "lexsort", slow)
    assert [x.tolist() for x in suffix_dedup.repeated_windows(pieces, length)] == want
