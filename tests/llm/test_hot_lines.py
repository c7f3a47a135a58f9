"""One line in many surroundings, cut level by level; a text over one block of places."""

import hashlib
import random
from collections import Counter

from webdelta.llm import suffix_dedup


def removed(texts, length):
    whole = {i: t.encode() for i, t in texts}
    seen = Counter(b[j : j + length] for b in whole.values() for j in range(len(b) - length + 1))
    out = {}
    for i, b in whole.items():
        gone = set()
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone.update(range(j, j + length))
        out[i] = hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()
    return out


def test_levels(spark, monkeypatch):
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    tail = "".join(rng.choice("abcd") for _ in range(12))
    texts = []
    for i in range(120):
        left, right = ("".join(rng.choice("xyz") for _ in range(rng.randint(0, 70))) for _ in range(2))
        texts.append((i, left + line + (tail[: rng.randint(0, 12)] if i % 3 else "") + right + (line if i % 10 == 0 else "")))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 4)
    for levels in ((20, 3, 1), (7, 1)):
        monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
        got = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.without_repeats(docs, 64, 16).collect()}
        assert got == removed(texts, 64)


def test_long_text():
    """Windows and anchors of a text over one block of places are those of any cut of it."""
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, (1 << 20) + 5000).astype(np.uint8)
    first, windows, place, h = suffix_dedup.anchors(data, 200, 40)
    assert windows.sum() == len(data) - 199
    at = np.repeat(place, windows)
    assert ((at >= np.arange(len(at))) & (at <= np.arange(len(at)) + 160)).all()
    tail = suffix_dedup.anchors(data[-9000:], 200, 40)
    start = len(data) - 9000
    assert (np.repeat(tail[2], tail[1]) + start == at[start:]).all()
