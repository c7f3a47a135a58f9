"""Greedy matching of similar blocks: what it writes to disk, and its result against candidates, distances and choice by definition."""

import random

import numpy as np
from pyspark.sql import functions as F

from webdelta.functions.similar import edits
from webdelta.functions.tokendiff import token_distance
from webdelta.operators import diff
from webdelta.plans import queries

BLOCK = "struct<seq:int,slot_key:string,ty:string,level:int,text:string,anchored_by:string>"


def written(spark):
    """Bytes of shuffles, spills and tables of all stages so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size())))


def test_texts_go_to_disk_once_a_side(spark, tmp_path):
    rng = random.Random(2)
    line = lambda: " ".join(f"{rng.getrandbits(40):x}" for _ in range(30))
    docs = [(i, "\n".join(line() for _ in range(40))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = written(spark)
    assert len(queries.queries()["greedy_match"](spark, str(tmp_path)).collect()) > 1000
    assert written(spark) - before < 3 * sum(len(t) for _, t in docs)


def blocks(rng):
    olds, news = [], []
    for k in range(24):
        vocab = ["the", "a", "é_1", "dog", "!", *(f"w{i}" for i in range(rng.choice([0, 10, 200])))]
        old = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 8, 30]))) for _ in range(rng.choice([1, 5, 40, 120]))]
        new = [t + rng.choice(["", " ", " edited", " a  dog"]) for t in old if rng.random() < 0.8]
        if k % 2:
            rng.shuffle(new)
        # Equal lines in buckets of more and of fewer than the most that is looked at.
        old, new = old + ["the dog"] * (k % 4 * 10), new + ["the dog"] * (k % 3 * 10)
        for side, out in ((old, olds), (new, news)):
            for q, t in enumerate(side):
                ty = rng.choice(["paragraph"] * 6 + ["table_row", "heading"])
                level = rng.choice([None, 1]) if ty == "heading" else None
                out.append((None if k == 0 else f"t{k}", 1, 2, (q * (1 + k % 2 * 2), rng.choice([None, f"s{q}"]), ty, level, None if rng.random() < 0.02 else t, rng.choice(["struct", "struct", None]))))
    return olds, news


def test_matches_are_those_of_the_definition(spark):
    olds, news = blocks(random.Random(5))
    o, n = (spark.createDataFrame(rows, f"tid string, from_rev long, to_rev long, {name} {BLOCK}") for rows, name in ((olds, "o"), (news, "n")))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = spark.conf.get(size)
    spark.conf.set(size, "37")
    try:
        places = {(r["tid"], r["o_seq"], r["n_seq"]): r["sim"] for r in diff.similar_places(o, n).collect()}
        pairs = diff.similar_pairs(o, n).collect()
    finally:
        spark.conf.set(size, most)
    scored = {}
    for r in diff.window_candidates(o, n).unionByName(diff.minhash_candidates(o, n)).select("tid", "o", "n", diff.affinity(F.col("o"), F.col("n")).alias("aff")).collect():
        x, y = r["o"], r["n"]
        if x["text"] is None or y["text"] is None:
            continue
        p, q = (set(t.replace("!", " ! ").split()) for t in (x["text"], y["text"]))
        jac = len(p & q) / len(p | q) if p | q else 1.0
        sim = float(np.float32(0.55 * jac + 0.30 * (1 - token_distance(x["text"], y["text"])) + 0.15 * r["aff"]))
        if sim >= (0.75 if x["ty"] == "table_row" else 0.62):
            scored[r["tid"], x["seq"], y["seq"]] = sim
    want, used = {}, set()
    for (t, a, b), s in sorted(scored.items(), key=lambda kv: (kv[0][0], -kv[1], kv[0][1:])):
        if ("o", t, a) not in used and ("n", t, b) not in used:
            used |= {("o", t, a), ("n", t, b)}
            want[t, a, b] = s
    assert places == want and any(abs(a - b) > 32 for _, a, b in want)
    assert {(r["tid"], r["o"]["seq"], r["n"]["seq"]): r["sim"] for r in pairs} == want and len(pairs) == len(want)
    texts = [{(t, b[0]): b[4] for t, _, _, b in rows} for rows in (olds, news)]
    assert all((r["o"]["text"], r["n"]["text"]) == (texts[0][r["tid"], r["o"]["seq"]], texts[1][r["tid"], r["n"]["seq"]]) for r in pairs)


def test_repeated_document_ids_match_each_place_once(spark, tmp_path):
    docs = [(1, "ash birch\ncedar"), (1, "ash birch\ncedar"), (1, "elm fir gum"), (None, "ash"), (2, None), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["greedy_match"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 1.0), (1, 1, 1, 1.0)]


def test_edits():
    rng = random.Random(9)
    for _ in range(300):
        x, y = ([rng.randrange(rng.choice([2, 5, 90])) for _ in range(rng.choice([0, 1, 6, 70, 140]))] for _ in range(2))
        want = token_distance(" ".join(map(str, x)), " ".join(map(str, y))) * max(len(x), len(y))
        assert edits(x, y) == round(want)
