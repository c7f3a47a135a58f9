"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from webdelta.llm import bpe, exact_dedup, jpeg, licenses, minhash, mixing, sharding, suffix_dedup, token_files, toxicity  # noqa: E402

VOCAB = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, shard int"
WORDS = "the of and stone river light under when many never green small house window paper walk sing cold north".split()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    make = lambda k: " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(k))
    base = make(60)
    texts = [None, "", " \t\n", "one", "One TWO", base, base, base.upper(), make(5000), "Σίσυφος ÀÉ 日本 \U0001f600 <|endoftext|> 's", "x" * 9000]
    texts += [make(rng.randint(1, 80)) for _ in range(n)]
    for _ in range(12):
        w = base.split()
        w[rng.randint(0, 59)] = make(1)
        texts.append(" ".join(w))
    passage = make(50)
    texts += [make(20) + " " + passage + " " + make(20) for _ in range(4)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "", None, "sé"]), None, "r", True, 7) for i, t in enumerate(texts)]
    return rows + [(None, "no id", None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in corpus() if r[0] is not None}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_exact_dedup(docs, texts, empty):
    got = by_id(exact_dedup.exact_dedup(docs, keep="largest"))
    # The rows without an id count in their groups; null ids are never the one to stay beside others.
    size = Counter(r[1] or "" for r in corpus())
    for i, t in texts.items():
        r = got[i]
        best = max(j for j, u in texts.items() if u == t)
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (best, size[t], i == best, hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.deduplicated(docs.union(docs))
    assert kept.columns == docs.columns and kept.count() == len(size)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0


def test_mixing(docs, texts, empty):
    got = mixing.mixed(docs).collect()
    again = {(r["doc_id"], r["text_hash"]): r["taken"] for r in mixing.mixed(docs.repartition(7)).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for r in corpus():
        total[r[3]] += size(r[1])
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(total, 0.0), 1.5 * sum(total.values()), set(total)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit >= 2 * total[s]}
        if not full:
            target |= {s: weight[s] * unit for s in free}
            break
        target |= {s: 2.0 * total[s] for s in full}
        left -= sum(2 * total[s] for s in full)
        free -= full
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and again[r["doc_id"], r["text_hash"]] == r["taken"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    rows = mixing.taken(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(empty).count() == 0


def test_pivots_keep_the_words_of_a_source_and_their_chances(spark):
    rows = [("a", i, 10 + i % 7, 0.3) for i in range(400)]
    hits = Counter()
    for seed in range(6):
        got = mixing.rounded(spark.createDataFrame(rows, "src string, id long, s long, p double"), seed).collect()
        assert len(got) == 400 and abs(sum(rows[r["id"]][2] * r["up"] for r in got) - 0.3 * sum(r[2] for r in rows)) <= 8
        hits.update(r["id"] for r in got if r["up"])
    assert 0.25 < sum(hits.values()) / 2400 < 0.35 and len(hits) > 250


def test_token_files(spark, docs, texts, empty):
    t = tokenizers.Tokenizer.from_file(VOCAB)
    got = by_id(token_files.token_files(docs, VOCAB, 2))
    start = sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in corpus() if r[0] is None)
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.token_files(empty, VOCAB).count() == 0
    for v in (np.array([], np.uint32), np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], np.uint32)):
        assert token_files.unpack(token_files.pack(v), len(v)).tolist() == v.tolist()


def test_suffix_dedup(docs, texts, empty):
    length = 200
    whole = [(r[0], (r[1] or "").encode()) for r in corpus()]
    seen = Counter(b[i : i + length] for _, b in whole for i in range(len(b) - length + 1))
    got = by_id(suffix_dedup.without_repeats(docs, length))
    for i, t in texts.items():
        b = t.encode()
        gone = set()
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone.update(range(j, j + length))
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        spans = sum(1 for j in gone if j - 1 not in gone)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), len(gone), spans, hashlib.sha256(kept).hexdigest())
    assert sum(r["n_removed"] for r in got.values()) > 0 and suffix_dedup.without_repeats(empty).count() == 0


def test_hot_anchors_are_split_without_loss(docs, monkeypatch):
    want = {i: r["kept_sha256"] for i, r in by_id(suffix_dedup.without_repeats(docs, 64, 16)).items()}
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 1)
    assert {i: r["kept_sha256"] for i, r in by_id(suffix_dedup.without_repeats(docs, 64, 16)).items()} == want


def test_merged_transforms():
    rng = random.Random(5)
    for length in (3, 12):
        for _ in range(20):
            pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 30))]
            seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
            assert [x.tolist() for x in suffix_dedup.repeated_windows(pieces, length)] == [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in pieces]


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    bad = ["stinker", "nastyface", "vilething"]
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        if toxic := i % 3 == 0:
            for _ in range(2):
                w = rng.choice(bad)
                words.insert(rng.randint(0, len(words)), w if rng.random() < 0.8 else w[:3] + rng.choice("xyz") + w[4:])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    got = toxicity.scored(d, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.9
    # A misspelling that training never saw shares n-grams with the word.
    seen, unseen, clean = toxicity.score_texts(model, ["the stinker of stone", "the stinkker of stone", "the river of stone"])
    assert seen > clean and unseen > clean
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.train(d, labels.limit(0)).constant == 0.0 and toxicity.scored(empty, model).count() == 0


def test_licenses(spark, docs, empty):
    full = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n'
    cases = [("text\n# Released under the MIT  License.", ["MIT"]), (full, ["MIT"]), ("Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "CC-BY-NC-4.0"]), ("licensed to nobody", []), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", [])]
    got = licenses.scanned(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == [want for _, want in cases] and got[4]["sentences"] == ["bsd-redistribution"]
    assert all(re.search(licenses.ANCHORS, s) for x in licenses.SENTENCES.values() for s in x)
    assert licenses.scanned(docs).count() == docs.count() and licenses.scanned(empty).count() == 0


def test_media(docs, texts, empty):
    got = by_id(jpeg.read_media(jpeg.with_media(docs), keep_payload=True))
    for i, t in texts.items():
        b = jpeg.padded(t.encode())
        r = got[i]
        assert (bytes(r["payload"]), r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (b, len(t.encode()), len(b), zlib.crc32(b[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(b).hexdigest()
    assert jpeg.read_media(jpeg.with_media(empty)).count() == 0


def test_jpeg_with_runs_and_colour():
    """A picture of three components, 2x1 sampling, zero runs and one long scan, put together bit by bit."""
    dc, ac = jpeg._canonical({2: [0, 1, 2], 3: [3]}), jpeg._canonical({2: [0x00, 0x01], 3: [0xF0, 0x11], 4: [0xE2]})
    bits, want, before = "", [], {0: 0, 1: 0, 2: 0}
    rng = random.Random(3)
    for _ in range(6):
        for c in (0, 0, 1, 2):
            value = before[c] + rng.randint(-3, 3)
            row = [0] * 64
            diff, before[c], row[0] = value - before[c], value, value
            size = abs(diff).bit_length()
            code, n = dc[size]
            bits += f"{code:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
            for symbol, at, v in ((0x11, 2, -1), (0xF0, 18, 0), (0xE2, 33, 3)):
                code, n = ac[symbol]
                bits += f"{code:0{n}b}" + {-1: "0", 0: "", 3: "11"}[v]
                if v:
                    row[at] = v
            code, n = ac[0]
            bits += f"{code:0{n}b}"
            want.append(row)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    seg = jpeg._segment
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\2" * 64) + seg(0xC0, bytes([8, 0, 16, 0, 40, 3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, jpeg._dht(0, {2: [0, 1, 2], 3: [3]}) + jpeg._dht(0x10, {2: [0, 1], 3: [0xF0, 0x11], 4: [0xE2]})) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    ((picture, found),) = jpeg.decode_images([head + scan + b"\xff\xd9"])
    assert found.tolist() == want and jpeg.thumbnail(picture, found).shape == (2, 5)


def _brute_components(sets, num, den):
    near, by = defaultdict(set), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for ids in by.values():
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if a != b and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    near[a].add(b)
    out = {}
    for i in sorted(sets):
        todo = [] if i in out else [i]
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = i
                todo += near[j]
    return out


@pytest.mark.parametrize("k, threshold, num, den", [(3, "0.85", 85, 100), (5, "0.8", 80, 100)])
def test_minhash(docs, texts, empty, k, threshold, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in texts.items()}
    want = _brute_components(sets, num, den)
    got = by_id(minhash.near_dedup(docs, k, threshold))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    if k == 5:
        kept = minhash.deduplicated(docs, k, threshold)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in want if want[i] == i} | {None}
        assert minhash.near_dedup(empty, k, threshold).count() == 0


def test_pivots_lose_no_link(spark):
    """Copies that are apart from each other, near a base, and of each other's edits; far strangers in the same buckets."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for g in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randint(0, 89)] = f"e{rng.randint(0, 12)}"
        rows.append((g, " ".join(w)))
    rows += [(100 + g, " ".join(base[:45] + [f"f{g}-{i % 40}" for i in range(45)])) for g in range(4)]
    sets = {i: frozenset(tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)) for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, "0.85").collect()}
    assert got == _brute_components(sets, 85, 100)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 1 << 63, 100, np.uint64)])
    small = a[:5]
    sig = minhash.signatures(np.concatenate([np.sort(a), np.sort(b), np.sort(small)]), np.array([300, 300, 5]), 200)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.12 and np.isfinite(sig).all() and sorted(np.floor(sig[2]).astype(int))[0] == 0


def test_bpe(docs, texts, empty):
    t = tokenizers.Tokenizer.from_file(VOCAB)
    got, plain = by_id(bpe.round_trip(docs, VOCAB)), by_id(bpe.decode(bpe.encode(docs, VOCAB), VOCAB))
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        out = t.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())
        assert plain[i]["text"] == out
    assert bpe.round_trip(empty, VOCAB).count() == 0


def test_streamed_words_equal_the_library():
    t, (v, _, _) = tokenizers.Tokenizer.from_file(VOCAB), bpe.loaded(VOCAB)
    rng = random.Random(4)
    for alphabet in ("ab", "theinrs", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rng.choice(alphabet) for _ in range(4000))
        assert list(v.stream(word.encode())) == t.encode(word, add_special_tokens=False).ids
        assert len(v.merged(list("x" * 10))) >= 1


def test_blocks_of_a_long_text_equal_the_library(spark, monkeypatch):
    t = tokenizers.Tokenizer.from_file(VOCAB)
    rng = random.Random(5)
    make = lambda: "".join(rng.choice(["é", "Σ", "日本", "a", "the", " ", "  ", "\n", "\t", "\r\n", "\x0b", "'s", "e\u0301", "\U0001f600", "<|endoftext|>", "\x1c", "x" * 40]) for _ in range(3000))
    texts = [make() for _ in range(4)] + ["w" * 300_000, ("long text " * 30_000) + "end", " " * 200_000, " " * 65_536 + "x"]
    got = by_id(bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCAB))
    _, words, decoder = bpe.loaded(VOCAB)
    for i, x in enumerate(texts):
        ids = t.encode(x, add_special_tokens=False).ids
        out, data = t.decode(ids, skip_special_tokens=False), np.array(ids, "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(out.encode()).hexdigest())
        if len(x) < 20_000:
            monkeypatch.setattr(bpe, "BLOCK", 7)
            blocks = list(words.blocks(x))
            assert len(blocks) > 9 and b"".join(blocks) == data and "".join(decoder.text(blocks, 3)) == out
            monkeypatch.undo()


def test_sharding(docs, texts, empty):
    got = sharding.sharded(docs, 8).collect()
    assert len(got) == docs.count()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            b = texts[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(b) + 16, zlib.crc32(b))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(size) <= set(range(8))
    largest = max(len(t.encode()) + 16 for t in texts.values())
    assert max(size.values()) <= sum(size.values()) / 8 + 2 * largest
    assert sharding.sharded(empty, 8).count() == 0


def test_one_hot_text_fills_many_shards(spark):
    rows = [(i, "same words again" if i < 300 else f"text {i} " * 3, "en", "s") for i in range(900)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 10).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert len(size) == 10 and max(size.values()) < 1.25 * min(size.values())
