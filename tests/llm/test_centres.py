"""Components beside a pivot against brute force: edits, shared passages, cuts and a pivot that is itself an outlier, in one group."""

import random
from collections import Counter

import pytest

from webdelta.llm import minhash


def texts(seed):
    rng = random.Random(seed)
    word = lambda n=300: f"w{rng.randrange(n)}"
    base = [word(5000) for _ in range(90)]
    passage = [word(5000) for _ in range(12)]
    out = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = word(6 if i % 3 == 0 else 5000)
        if i % 4 == 0:
            w += passage[: rng.randint(3, 12)]
        if i % 5 == 0:
            w = w[: len(w) - rng.randint(2, 25)]
        if i % 7 == 0:
            w += [word(5000) for _ in range(rng.randint(2, 14))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,threshold,num,den", [(3, "0.85", 85, 100)])
def test_groups_with_many_outliers(spark, monkeypatch, k, threshold, num, den):
    rows = list(enumerate(texts(4)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i: find(i) for i in sets}
    assert 20 < len(set(want.values())) < 150
    # All nodes in one bucket, so that every link must be found beside its pivot.
    sketch = minhash.sketched
    monkeypatch.setattr(minhash, "sketched", lambda *a: sketch(*a).withColumn("bands", minhash.F.expr("transform(slice(bands, 1, 1), x -> 1L)")))
    monkeypatch.setattr(minhash, "PAIRS", 0)
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k, threshold).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
