"""Mixing sources to target weights: Pivotal dependent rounding over a reduction tree, in DataFrame functions only.

Each source has a target in words. A document's copies are target / source size; the whole part is certain, the fraction is
a probability p. Units with a fraction meet in blocks of about BLOCK. A block is folded: the unit in hand and the next one,
weighing s and t words, trade mass s*p against t*q until one is integral, in one of the two directions, drawn so that each
keeps its expectation; the words of the pair never change. A block leaves at most one fractional unit, which enters the
next level of the tree, where BLOCK neighbours meet, so no group is large. The last unit of a source takes the nearer of 0 and 1, so a source misses its target by at most half of one document. Larger documents are settled first.

Targets: sources in code point order, null last, weigh `weights` in turn and share `share` of all words; none gets more
than `cap` of its own size, and the excess is shared anew by weight until none is above.

Draws are hashes of the seed, the level and the two units, so reruns agree. Defined results: null text has no words, and a
document without words draws its fraction alone. A null source is a source. Rows that repeat id and text are
separate units. An empty table gives an empty result. Columns of other names stay untouched.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdelta.llm.common import WORD, in_order, joined_with_hot, stored, text_of, whole_row

BLOCK = 48
_UNIT = "struct<id:long,s:long,p:double>"
_STATE = f"struct<hand:{_UNIT},done:array<struct<id:long,up:int>>>"


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes: source, size. One row per source: source, source_size, target."""
    by_source = stored(in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").isNull(), F.col("source")], "sources"), "ranked-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    rows = by_source.select("source", "source_size", weight.alias("weight"), limit.alias("limit"))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    unit, held = 0.0, None
    while True:  # each round fixes at least one more source at its limit
        full = F.col("limit") <= F.col("weight") * unit
        got = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if got[0] == held or not got[2]:
            break
        held, unit = got[0], max(unit, (total * share - got[1]) / got[2])
    return rows.select("source", "source_size", F.least("limit", F.col("weight") * unit).alias("target"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _fold(seed: Column) -> Column:
    """The state after all units of the array `units`."""
    unit = lambda id_, s, p: F.struct(id_.alias("id"), s.alias("s"), p.alias("p"))
    settled = lambda u: F.struct(u["id"].alias("id"), u["p"].cast("int").alias("up"))
    none = F.lit(None).cast(_UNIT)

    def meet(state: Column, b: Column) -> Column:
        a = state["hand"]
        up = F.least((1 - a["p"]) * a["s"], b["p"] * b["s"])  # words that may go from b to a
        down = F.least(a["p"] * a["s"], (1 - b["p"]) * b["s"])
        draw = F.shiftrightunsigned(F.xxhash64(seed, a["id"], b["id"]), 11) / F.lit(float(1 << 53))

        def moved(m: Column) -> Column:
            rise, fall = m["up"], m["down"]
            to_a = m["draw"] * (rise + fall) < fall
            by = F.when(to_a, rise).otherwise(fall)
            # Whoever has no more than that to give or take is settled, rounding errors aside.
            a_whole = F.when(to_a, (1 - a["p"]) * a["s"]).otherwise(a["p"] * a["s"]) - by <= 1e-9
            b_whole = F.when(to_a, b["p"] * b["s"]).otherwise((1 - b["p"]) * b["s"]) - by <= 1e-9
            sign = F.when(to_a, 1.0).otherwise(-1.0)
            new_a = F.when(a_whole, F.when(to_a, 1.0).otherwise(0.0)).otherwise(a["p"] + sign * by / a["s"])
            new_b = F.when(b_whole, F.when(to_a, 0.0).otherwise(1.0)).otherwise(b["p"] - sign * by / b["s"])
            return F.struct(new_a.alias("pa"), new_b.alias("pb"), a_whole.alias("wa"), b_whole.alias("wb"))

        def next_state(r: Column) -> Column:
            ua, ub = unit(a["id"], a["s"], r["pa"]), unit(b["id"], b["s"], r["pb"])
            hand = F.when(r["wa"] & r["wb"], none).when(r["wa"], ub).otherwise(ua)
            done = F.when(r["wa"] & r["wb"], F.array(settled(ua), settled(ub))).when(r["wa"], F.array(settled(ua))).otherwise(F.array(settled(ub)))
            return F.struct(hand.alias("hand"), F.concat(state["done"], done).alias("done"))

        traded = _let(_let(F.struct(up.alias("up"), down.alias("down"), draw.alias("draw")), moved), next_state)
        return F.when(a.isNull(), F.struct(b.alias("hand"), state["done"].alias("done"))).otherwise(traded).cast(_STATE)

    start = F.struct(none.alias("hand"), F.array().cast("array<struct<id:long,up:int>>").alias("done")).cast(_STATE)
    return F.aggregate(F.col("units"), start, meet)


def rounded(units: DataFrame, seed: int) -> DataFrame:
    """units: src, id, s (over 0), p in (0, 1); ids are unique. Returns id, up (0 or 1) for each."""
    most = units.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    width, level, settled = max(1, -(-most // BLOCK)), 0, []
    units = units.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(width)))
    while True:
        order = F.struct((-F.col("s")).alias("o"), F.xxhash64("id").alias("h"), "id", "s", "p")
        met = units.groupBy("src", "block").agg(F.array_sort(F.collect_list(order)).alias("all"))
        met = met.select("src", "block", F.transform("all", lambda u: F.struct(u["id"].alias("id"), u["s"].alias("s"), u["p"].alias("p"))).alias("units"))
        met = stored(met.select("src", "block", _fold(F.lit(seed * 1000 + level)).alias("state")), "pivots")
        settled.append(met.select(F.explode("state.done").alias("d")).select("d.id", "d.up"))
        left = met.filter("state.hand IS NOT NULL").select("src", (F.col("block") / BLOCK).cast("long").alias("block"), "state.hand.id", "state.hand.s", "state.hand.p")
        if width == 1:
            settled.append(left.select("id", (F.col("p") >= 0.5).cast("int").alias("up")))
            return functools.reduce(DataFrame.unionByName, settled)
        units, width, level = left, -(-width // BLOCK), level + 1


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken (words), text_hash."""
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash"))
    # Ranging by ids reads its input twice, so the texts are counted and hashed before it.
    rows = in_order(stored(rows, "words"), [F.col(c) for c in ("id", "source", "size", "text_hash")], "sizes").withColumnRenamed("rank", "uid")
    # The key tells a null source from an empty one and can be joined on.
    rows = stored(rows.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "numbered")
    aims = targets(rows, weights, share, cap).withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    aims = stored(aims.join(rows.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows")), "src"), "targets")
    total = aims.agg(F.sum("n_rows")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = joined_with_hot(rows, aims, ["src"], "n_rows", total).withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    rows = stored(rows, "aimed")
    drawn = rounded(rows.filter("p > 0 AND size > 0").select("src", F.col("uid").alias("id"), F.col("size").alias("s"), "p"), seed).withColumnRenamed("id", "uid")
    empty = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "uid"), 11) / F.lit(float(1 << 53)) < F.col("p")).cast("int")
    copies = F.col("whole") + F.when(F.col("size") == 0, empty).otherwise(F.coalesce("up", F.lit(0)))
    out = rows.join(drawn, "uid", "left").withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: docs' rows with docs' columns, each as often as it is taken. Rows that repeat id, source and text pool their copies."""
    found = mixed(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    pooled = found.groupBy(F.col(id_col).alias("m_id"), F.col(source_col).alias("m_source"), F.col("text_hash").alias("m_hash")).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.xxhash64(text_of(docs, text_col)).alias("hash"), whole_row(docs).alias("row"))
    same = rows["id"].eqNullSafe(pooled["m_id"]) & rows["source"].eqNullSafe(pooled["m_source"]) & (rows["hash"] == pooled["m_hash"])
    plain = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    first = Window.partitionBy("id", "source", "hash").orderBy(F.xxhash64(*plain))
    got = rows.join(pooled, same).withColumn("n", F.row_number().over(first)).filter("n = 1")
    return got.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
