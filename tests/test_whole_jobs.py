"""Queries over whole inputs against brute force, on small tables of their own."""

import math
import random
import re
from collections import Counter

import numpy as np

from webdelta.functions.tokendiff import token_distance
from webdelta.plans import queries


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_entropy_of_whole_texts(spark, tmp_path):
    texts = ["", "aaaa", "a" * 60 + "bcdefgh" * 20, "é日\U0001f600 \0x$1\\" * 30, None]
    table(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["bits"] for r in queries.queries()["entropy_tokens"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts[:-1]):
        b = t.encode()
        assert abs(got[i] - sum(-c / len(b) * math.log2(c / len(b)) for c in Counter(b).values())) < 2e-6
    assert got[4] is None


def test_jaccard_of_all_pairs(spark, tmp_path):
    items = [(1, "the cat sat, the end"), (2, ""), (3, None), (60, "é_1   dog!")]
    docs = [(0, "a cat sat"), (7, "  \n"), (12, "dog dog é_1 ! the"), (13, None)]
    table(spark, tmp_path, "benchmark", items, "item_id long, text string")
    table(spark, tmp_path, "documents", docs, "doc_id long, text string")
    words = lambda t: {w for w in re.findall(r"\w+|[^\w\s]", t)}
    want = {}
    for i, a in items:
        for j, b in docs:
            x, y = (words(a), words(b)) if a is not None and b is not None else (None, None)
            want[i, j] = None if x is None else round(len(x & y) / len(x | y), 9) if x | y else 1.0
    got = queries.queries()["token_jaccard"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["item_id"], r["doc_id"]): r["jaccard"] for r in got} == want


def test_greedy_over_all_lines(spark, tmp_path):
    rng = random.Random(4)
    pool = "ash birch cedar elm fir gum".split()
    docs = [(i, "\n".join(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 50)))) for i in range(4)]
    table(spark, tmp_path, "documents", docs, "doc_id long, text string")
    got = {(r["doc_id"], r["old_seq"], r["new_seq"]): r["sim"] for r in queries.queries()["greedy_match"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in docs:
        old = dict(enumerate(t.split("\n")))
        new = {k: v + " edited" if k % 11 == 5 else v for k, v in old.items() if k % 7 != 3} | ({100001: old[1]} if 1 in old else {})
        pairs = []
        for a, x in old.items():
            for b, y in new.items():
                p, q = set(x.split()), set(y.split())
                aff = 1.0 if a == b else 0.6 + 0.2 + 0.2
                sim = float(np.float32(0.55 * (len(p & q) / len(p | q)) + 0.30 * (1 - token_distance(x, y)) + 0.15 * aff))
                # Lines further apart meet through MinHash only, which has no brute force: only what was chosen is looked at.
                if abs(a - b) <= 32 or (i, a, b) in got:
                    pairs += [(-sim, a, b)] if sim >= 0.62 else []
        olds, news = set(), set()
        for s, a, b in sorted(pairs):
            if a not in olds and b not in news:
                olds.add(a), news.add(b)
                want[i, a, b] = -s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    assert any(a % 11 != 5 for _, a, _ in got)
