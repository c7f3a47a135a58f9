"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

SuperMinHash gives each element of a set a random permutation of the m components and random numbers r_j; component
p(j) takes the smallest r_j + j over all elements. Ranks are integers apart, so once every component has a value below j,
step j cannot lower any: a set stops there, and large sets stop after the first step. Components are correlated, which
lowers the variance of the estimate below that of independent ones. Bands of `rows` components make the buckets.

Documents with equal sets are one node, so copies never make pairs. In each bucket all nodes are compared with one pivot
(the node with the smallest hash), on full sets; what a node lacks of the pivot and what it adds is kept where its Jaccard
is NEAR or more. A node below NEAR can link only with nodes below NEAR + 1 - t, since 1 - Jaccard is a metric; those,
without the pivot, are the bucket's rest and get a pivot of their own. Once all rests together hold at most PAIRS pairs for
each set, they are compared pair by pair.

The nodes near a pivot are then seen from a centre C: the elements that more than half of them have, one aggregation over
their differences. With L(x) lacks of C, A(x) additions and the cost c(x) = (1 - a) L(x) + a A(x), where a = t / (1 + t),
two nodes reach Jaccard t just when

    common lacks + common additions  >=  need  =  c(x) + c(y) - |C| (1 - 2 a).

The node m of least cost therefore links to every x with c(x) + c(m) <= |C| (1 - 2 a), whatever they share: one group, with
the pivot's links where m is one of them. A pair with a node r outside that group has need > 0. Common lacks are min(L) at
most, so either the pair shares at least need - min(L) of the rare additions, or lacks alone may do. Both cases are excluded
for whole classes of nodes of equal L by their least A and their largest number of shared additions; what is left is joined
on additions that two nodes have, or paired within the class behind a bit map of lacks, and confirmed on the full
differences. Edited copies far from each other thus need no pairs, though their lacks overlap. No bucket is capped and no
group of copies is expanded. Groups are found by hashing to the smallest neighbour until nothing changes.

A pair at the threshold meets in no band with probability (1 - t^rows)^bands: 8e-6 for 5 x 20 at 0.85 and 2e-6 for 4 x 25
at 0.8; lower thresholds get shorter bands, MISS at most, or are refused. Defined results: texts without words have an empty set and link with nothing. Rows that repeat an id are judged each by
its own text. Rows without an id link with nothing: their component is null, and they are kept. Null text is empty. An
empty table gives an empty result. Other columns, whatever their names, are untouched.
"""

from __future__ import annotations

import functools
import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdelta.llm.common import discard, joined_with_hot, lean, slices, stored, whole_row
from webdelta.llm.words import mix, shingle_sets

#: Partners of a pivot that are verified in one group of rows; pairs for each set that the last rests may hold.
GROUP, PAIRS = 256, 5
#: Components of a signature, and the probability with which a pair at the threshold may meet in no band.
COMPONENTS, MISS = 100, 1e-5
#: Jaccard from which a node's differences from its pivot are kept.
NEAR = Fraction(1, 16)


def bands_for(threshold: float) -> tuple[int, int]:
    """rows, bands: of COMPONENTS, the longest bands of up to 5 rows that miss a pair at the threshold with probability MISS at most."""
    for rows in (5, 4, 3, 2, 1):
        if (1 - threshold**rows) ** (COMPONENTS // rows) <= MISS:
            return rows, COMPONENTS // rows
    raise ValueError(f"threshold {threshold}: {COMPONENTS} components miss more than {MISS} of the pairs at it")


def signatures(values: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash of sets laid one after the other: a row of m for each; of an empty set, infinity."""
    out = np.full((len(sizes), m), np.inf)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    flat = out.reshape(-1)
    perm = None
    for j in range(m):
        if not len(doc):
            break
        h = mix(values + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) % (1 << 64)))
        rank = (h >> np.uint64(32)).astype(np.float64) / 2**32
        swap = j + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            place = swap
        else:
            i = np.arange(len(doc))
            place = perm[i, swap].astype(np.int64)
            perm[i, swap] = perm[:, j]
        key = doc * m + place
        # The smallest of each component: falling order, so the last write stays.
        order = np.argsort(-rank, kind="stable")
        key, low = key[order], rank[order] + j
        best = np.full(len(flat), np.inf)
        best[key] = low
        np.minimum(flat, best, out=flat)
        # A set is settled once all its components are below the next rank.
        open_ = (out >= j + 1).any(1)
        stay = open_[doc]
        if perm is None and stay.any():
            perm = np.tile(np.arange(m, dtype=np.uint8 if m < 256 else np.uint16), (int(stay.sum()), 1))
            i = np.arange(len(perm))
            s = swap[stay]
            perm[i, s] = 0
            perm[:, 0] = s
        elif perm is not None:
            perm = perm[stay]
        doc, values = doc[stay], values[stay]
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketched(docs: DataFrame, k: int, rows: int, bands: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n_shingles, set_key (16 bytes, null for an empty set), bands (a hash for each)."""

    @lean
    def run(batches):
        place = np.random.default_rng(7).integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        for b in slices(batches, most=2 << 20):
            values, sizes = shingle_sets([(t or "").encode() for t in b.column("text").to_pylist()], k)
            sig = signatures(values, sizes, rows * bands)
            ends = np.cumsum(sizes)
            raw = values.tobytes()
            keys = [hashlib.blake2b(raw[8 * (e - n) : 8 * e], digest_size=16).digest() if n else None for n, e in zip(sizes.tolist(), ends.tolist())]
            bits = np.where(np.isinf(sig), 0.0, sig).view(np.uint64).reshape(-1, bands, rows)
            hashed = mix((mix(bits) * place).sum(2, dtype=np.uint64)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(hashed.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(sizes), pa.array(keys, pa.binary()), lists], ["id", "text_hash", "n_shingles", "set_key", "bands"])

    x = _texts(docs, id_col, text_col)
    return x.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, text_hash long, n_shingles long, set_key binary, bands array<long>")


def compared(pairs: DataFrame, texts: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """pairs: pivot, node, n (partners of the pivot); texts: set_key, text. Returns pivot, node, linked, near, far, p_size, lacks, adds (hashes; only of near nodes)."""
    # Partners of one pivot are dealt to groups of about GROUP; the pivot's text goes to each of them.
    groups = F.ceil(F.col("n") / GROUP).cast("int")
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("node"), groups).cast("int"))
    of_pivot = texts.select(F.col("set_key").alias("pivot"), F.col("text").alias("p_text"))
    pivots = pairs.groupBy("pivot").agg(F.max("n").alias("n")).join(of_pivot, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), groups - 1)).alias("deal"), "p_text")
    both = dealt.join(texts.select(F.col("set_key").alias("node"), "text"), "node").join(pivots, ["pivot", "deal"]).select("pivot", "node", "p_text", "text")
    num, den, reach = threshold.numerator, threshold.denominator, NEAR + 1 - threshold

    @lean
    def run(batches):
        for b in slices(batches, ("p_text", "text"), 2 << 20):
            pivots, nodes = b.column("pivot"), b.column("node")
            p_texts = b.column("p_text").to_pylist()
            unique: dict[str, int] = {}
            of = [unique.setdefault(t or "", len(unique)) for t in p_texts]
            pv, pn = shingle_sets([t.encode() for t in unique], k)
            xv, xn = shingle_sets([(t or "").encode() for t in b.column("text").to_pylist()], k)
            pe, xe = np.cumsum(pn), np.cumsum(xn)
            linked, near, far, p_size, lacks, adds = [], [], [], [], [], []
            none = np.zeros(0, np.int64)
            for i, u in enumerate(of):
                p, x = pv[pe[u] - pn[u] : pe[u]], xv[xe[i] - xn[i] : xe[i]]
                lack = np.setdiff1d(p, x, assume_unique=True)
                both, union = len(p) - len(lack), len(x) + len(lack)
                linked.append(both * den >= num * union)
                near.append(both * NEAR.denominator >= NEAR.numerator * union)
                far.append(both * reach.denominator < reach.numerator * union)
                p_size.append(len(p))
                lacks.append(lack.view(np.int64) if near[-1] else none)
                adds.append(np.setdiff1d(x, p, assume_unique=True).view(np.int64) if near[-1] else none)
            columns = [pivots, nodes, pa.array(linked), pa.array(near), pa.array(far), pa.array(p_size, pa.int64()), pa.array(lacks, pa.list_(pa.int64())), pa.array(adds, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["pivot", "node", "linked", "near", "far", "p_size", "lacks", "adds"])

    return both.mapInArrow(run, "pivot binary, node binary, linked boolean, near boolean, far boolean, p_size long, lacks array<long>, adds array<long>")


def links(sets: DataFrame, docs: DataFrame, k: int, threshold: Fraction, id_col: str, text_col: str) -> DataFrame:
    """sets: set_key, id and text_hash of one document that has the set, bands. Returns links between sets: a, b."""
    all_rows = stored(sets.select("set_key", F.posexplode("bands").alias("band", "hash")), "bands")
    sizes = stored(all_rows.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    rows = stored(joined_with_hot(all_rows, sizes, ["band", "hash"], "n", total).select("band", "hash", "set_key"), "buckets")
    discard(all_rows)
    wanted = rows.select("set_key").distinct().join(sets.select("set_key", "id", "text_hash"), "set_key")
    texts = stored(_texts(docs, id_col, text_col).join(wanted, ["id", "text_hash"]).select("set_key", "text").dropDuplicates(["set_key"]), "texts")
    done, direct, n_sets = None, [], sets.count()
    while True:
        first = F.min(F.struct(F.xxhash64("set_key").alias("h"), F.col("set_key"))).alias("p")
        # Buckets of other bands with the same nodes (by a 128-bit sum over them) are one.
        same = [F.bit_xor(F.xxhash64("set_key", F.lit(i))).alias(f"x{i}") for i in (0, 1)]
        heads = rows.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), first, *same).filter("n > 1").groupBy("n", "x0", "x1").agg(F.min(F.struct("band", "hash", "p")).alias("b"))
        heads = stored(heads.select("b.band", "b.hash", "n", F.col("b.p.set_key").alias("pivot")), "heads")
        total = heads.agg(F.sum("n")).first()[0] or 0
        if not total:
            break
        # Few enough to compare pair by pair: their number is bounded by the number of sets.
        if done is not None and heads.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] <= PAIRS * n_sets:
            rest = rows.join(heads.select("band", "hash"), ["band", "hash"])
            pair = rest.withColumnRenamed("set_key", "pivot").join(rest.withColumnRenamed("set_key", "node"), ["band", "hash"]).filter("pivot < node").select("pivot", "node").distinct()
            direct.append(_verified(pair, texts, k, threshold).filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
            break
        met = stored(joined_with_hot(rows, heads, ["band", "hash"], "n", total).filter("set_key <> pivot").select("band", "hash", "pivot", F.col("set_key").alias("node")), "met")
        new = met.select("pivot", "node").distinct()
        new = new if done is None else new.join(done.select("pivot", "node"), ["pivot", "node"], "left_anti")
        found = _verified(new, texts, k, threshold)
        done = found if done is None else stored(done.unionByName(found), "compared")
        far = done.filter("far").select("pivot", "node")
        rows = stored(met.join(far, ["pivot", "node"]).select("band", "hash", F.col("node").alias("set_key")), "far")
    if done is None:
        return sets.select(F.col("set_key").alias("a"), F.col("set_key").alias("b")).limit(0)
    direct.append(done.filter("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    return functools.reduce(DataFrame.unionByName, direct).unionByName(_beside_pivots(done.filter("near"), threshold))


def _verified(pairs: DataFrame, texts: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """pairs (pivot, node) on full sets; a pivot's partners are dealt to groups by their number."""
    pairs = stored(pairs, "pairs")
    sized = stored(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")), "pivots")
    total = sized.agg(F.sum("n")).first()[0] or 0
    return stored(compared(joined_with_hot(pairs, sized, ["pivot"], "n", total), texts, k, threshold), "compared")


def _beside_pivots(found: DataFrame, threshold: Fraction) -> DataFrame:
    """Links between nodes near one pivot, beside the pivot's own: of the centre's medoid, and of nodes outside its group."""
    num, den = threshold.numerator, threshold.denominator
    unit = num + den
    found = stored(found.select("pivot", "node", "linked", "p_size", "lacks", "adds"), "near")
    total = found.count()
    by_pivot = found.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("linked")).alias("apart"), F.first("p_size").alias("p_size"))
    by_pivot = stored(by_pivot.filter("n > 1 AND apart > 0").drop("apart"), "open-pivots")
    none = F.array().cast("array<long>")
    own = by_pivot.select("pivot", F.col("pivot").alias("node"), F.lit(True).alias("linked"), "p_size", none.alias("lacks"), none.alias("adds"), "n")
    nodes = stored(joined_with_hot(found.drop("p_size"), by_pivot, ["pivot"], "n", total).unionByName(own), "beside")
    # The centre: the pivot's set, changed where more than half of the n + 1 nodes differ from it. All costs are in units of 1 / (num + den).
    votes = nodes.select("pivot", "n", F.size("lacks").alias("l"), F.posexplode(F.concat("lacks", "adds")).alias("at", "e"))
    flips = votes.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first(F.col("at") < F.col("l")).alias("lack")).filter("2 * m > n + 1")
    flips = flips.groupBy("pivot").agg(F.collect_list(F.when(F.col("lack"), F.col("e"))).alias("out"), F.collect_list(F.when(~F.col("lack"), F.col("e"))).alias("in"))
    # Each flip has over n / 2 votes, so a pivot's flips are at most twice as many as a node's differences. They go to each group of nodes.
    groups = F.ceil(F.col("n") / GROUP).cast("int")
    flips = by_pivot.join(flips, "pivot", "left").select("pivot", F.coalesce("out", none).alias("out"), F.coalesce("in", none).alias("in"), F.explode(F.sequence(F.lit(0), groups)).alias("deal"))
    seen = nodes.withColumn("deal", F.pmod(F.xxhash64("node"), groups + 1).cast("int")).join(flips, ["pivot", "deal"])
    lacks = F.concat(F.array_except("lacks", "out"), F.array_except("in", "adds"))
    adds = F.concat(F.array_except("adds", "in"), F.array_except("out", "lacks"))
    full = (F.col("p_size") - F.size("out") + F.size("in")) * (den - num)
    seen = seen.select("pivot", "node", "linked", "n", full.alias("full"), lacks.alias("lacks"), adds.alias("adds"))
    # 256 bits of the lacks.
    bits = [F.expr(f"aggregate(filter(lacks, x -> (x & 3) = {i}), 0L, (m, x) -> m | shiftleft(1L, cast((x >> 2) & 63 as int)))").alias(f"w{i}") for i in range(4)]
    seen = stored(seen.select("*", F.size("lacks").alias("l"), F.size("adds").alias("a"), (F.size("lacks") * den + F.size("adds") * num).cast("long").alias("cost"), *bits), "seen")
    heads = stored(seen.groupBy("pivot").agg(F.min(F.struct("cost", "node", "linked")).alias("m"), F.count(F.lit(1)).alias("n")).select("pivot", "m", "n"), "medoids")
    n_nodes = heads.agg(F.sum("n")).first()[0] or 0
    core = F.col("cost") + F.col("m.cost") <= F.col("full")
    marked = joined_with_hot(seen.drop("n"), heads, ["pivot"], "n", n_nodes).withColumn("core", core)
    marked = stored(marked.withColumn("main", F.col("core") | (F.col("node") == F.col("m.node")) | (F.col("linked") & F.col("m.linked"))), "marked")
    direct = marked.filter(F.col("core") & (F.col("node") != F.col("m.node"))).select(F.col("m.node").alias("a"), F.col("node").alias("b"))
    # Additions that an outer node and one more have.
    open_ = stored(marked.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("main")).alias("outer")).filter("outer > 0").select("pivot", "n"), "open")
    left = joined_with_hot(marked.drop("n", "m", "core", "linked"), open_, ["pivot"], "n", n_nodes)
    left = stored(left.drop("n"), "left")
    each = left.select("pivot", "node", "main", "l", "cost", "full", F.explode("adds").alias("e"))
    common = each.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("main")).alias("u")).filter("m > 1 AND u > 0").select("pivot", "e")
    shared = stored(each.join(common, ["pivot", "e"]), "shared")
    count = shared.groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("s"))
    sized = left.drop("lacks", "adds").join(count, ["pivot", "node"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    sized = stored(sized, "sized")
    outer = sized.filter("NOT main")
    # For kinds of outer nodes and classes of equal l: the shared additions that a pair needs beside all common lacks, at the least.
    classes = sized.groupBy("pivot", "l").agg(F.min("a").alias("az"), F.max("s").alias("sz")).withColumnRenamed("l", "lz")
    need = F.col("cost") + F.col("lz") * den + F.col("az") * num - F.col("full") - F.least("l", "lz") * unit
    kinds = outer.select("pivot", "l", "a", "s", "cost", "full").distinct().join(classes, "pivot").withColumn("need", need).filter(F.col("need") <= F.least("s", "sz") * unit)
    kinds = stored(kinds.select("pivot", "l", "a", "s", "lz", "need"), "kinds")
    by_adds = outer.join(kinds.filter("need > 0").select("pivot", "l", "a", "s").distinct(), ["pivot", "l", "a", "s"], "left_semi").select("pivot", "node")
    x = shared.join(by_adds, ["pivot", "node"], "left_semi").select("pivot", "e", F.col("node").alias("x"), F.col("l").alias("lx"), F.col("cost").alias("cx"), "full")
    y = shared.select("pivot", "e", F.col("node").alias("y"), F.col("l").alias("ly"), F.col("cost").alias("cy"), F.col("main").alias("my"))
    once = (F.col("my") & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y"))
    met = x.join(y, ["pivot", "e"]).filter(once).groupBy("pivot", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("cx") + F.col("cy") - F.col("full") - F.least("lx", "ly") * unit).alias("need"))
    met = met.filter(F.col("n") * unit >= F.col("need")).select("pivot", "x", "y")
    words = [f"w{i}" for i in range(4)]
    x = outer.join(kinds.filter("need <= 0").select("pivot", "l", "a", "s", "lz"), ["pivot", "l", "a", "s"]).select("pivot", F.col("lz").alias("ly"), F.col("node").alias("x"), F.col("l").alias("lx"), F.col("cost").alias("cx"), F.col("s").alias("sx"), "full", *[F.col(w).alias(f"x{w}") for w in words])
    y = sized.select("pivot", F.col("l").alias("ly"), F.col("node").alias("y"), F.col("cost").alias("cy"), F.col("s").alias("sy"), F.col("main").alias("my"), *[F.col(w).alias(f"y{w}") for w in words])
    only = lambda p, q: functools.reduce(lambda u, v: u + v, [F.bit_count(F.col(f"{p}{w}").bitwiseAND(F.bitwise_not(F.col(f"{q}{w}")))) for w in words])
    most = F.least(F.col("lx") - only("x", "y"), F.col("ly") - only("y", "x")) + F.least("sx", "sy")
    alike = x.join(y, ["pivot", "ly"]).filter(once & (most * unit >= F.col("cx") + F.col("cy") - F.col("full"))).select("pivot", "x", "y")
    pairs = stored(met.unionByName(alike).distinct(), "candidates")
    full_sets = left.select("pivot", "node", "lacks", "adds", "cost", "full")
    of = lambda k: full_sets.select("pivot", F.col("node").alias(k), F.col("lacks").alias(f"l{k}"), F.col("adds").alias(f"a{k}"), F.col("cost").alias(f"c{k}"), *(["full"] if k == "x" else []))
    both = pairs.join(of("x"), ["pivot", "x"]).join(of("y"), ["pivot", "y"])
    same = F.size(F.array_intersect("lx", "ly")) + F.size(F.array_intersect("ax", "ay"))
    linked = both.filter(same * unit >= F.col("cx") + F.col("cy") - F.col("full")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return stored(direct.unionByName(linked).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. One row per node: node, component (the smallest node that it reaches).

    Rounds of large-star and small-star: each node's larger neighbours, then its smaller ones and itself, are linked to the
    smallest it sees. A node with many neighbours is joined by broadcast, so its edges stay in many tasks.
    """

    def star(e: DataFrame, name: str) -> DataFrame:
        low = stored(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), name)
        total = low.agg(F.sum("n")).first()[0] or 0
        return joined_with_hot(e, low, ["u"], "n", total)

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = stored(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = stored(star(both, "large").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        small = star(large, "small")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        small = stored(small.filter("u <> v").distinct(), "small-star")
        same = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = small
        if same:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _judged(docs: DataFrame, k: int, threshold: str | float, id_col: str, text_col: str) -> DataFrame:
    t = Fraction(str(threshold))
    rows, bands = bands_for(float(t))
    sketch = stored(sketched(docs, k, rows, bands, id_col, text_col), "sketch")
    named = sketch.filter("set_key IS NOT NULL AND id IS NOT NULL")
    sets = named.groupBy("set_key").agg(F.min(F.struct("id", "text_hash", "bands")).alias("f"), F.count(F.lit(1)).alias("n"))
    sets = stored(sets.select("set_key", "f.id", "f.text_hash", "f.bands", "n"), "sets")
    found = components(links(sets, docs, k, t, id_col, text_col))
    placed = stored(sets.select("set_key", "id", "n").join(found, F.col("set_key") == F.col("node"), "left").select("set_key", "id", "n", F.coalesce("component", "set_key").alias("root")), "placed")
    roots = stored(placed.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n_sets")), "roots")
    n_sets, n_rows = (x or 0 for x in placed.agg(F.count(F.lit(1)), F.sum("n")).first())
    by_set = stored(joined_with_hot(placed, roots, ["root"], "n_sets", n_sets).select("set_key", "n", "component_id"), "by-set")
    linked = joined_with_hot(named.drop("bands"), by_set, ["set_key"], "n", n_rows).select("id", "text_hash", "n_shingles", "component_id")
    alone = sketch.filter("set_key IS NULL OR id IS NULL").select("id", "text_hash", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, k: int = 5, threshold: str | float = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id it reaches), kept (its id is that)."""
    return _judged(docs, k, threshold, id_col, text_col).drop("text_hash").withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, k: int = 5, threshold: str | float = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows without the near duplicates: of each component the row with the smallest id, with docs' columns."""
    gone = _judged(docs, k, threshold, id_col, text_col).filter("NOT kept").select(F.col("id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("hash"), whole_row(docs).alias("row"))
    return rows.join(gone, (F.col("id") == F.col("g_id")) & (F.col("hash") == F.col("g_hash")), "left_anti").select("row.*")
