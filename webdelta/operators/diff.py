"""Changed pairs of observations to change units: equi-joins on slot keys, then exact, then similar residuals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdelta.functions.similar import MAX_BUCKET, SEEDS, WINDOW, similar_blocks
from webdelta.functions.text import collapse, tokens, word_tokens
from webdelta.functions.tokendiff import first_unused, increasing, inline_diff_udf
from webdelta.plans.tables import settled

PAIR = ["tid", "from_rev", "to_rev"]
MOVED_RUN, MAX_CHILDREN, SAMPLE = 3, 32, 8
TEXT_CAP = 600
#: Words of the noise rules.
KEY_WORDS = ["price", "cost", "qty", "quantity", "stock", "version"]
CUE_WORDS = ["viewing", "online", "ago", "watching", "viewers", "now", "live", "people", "active"]
_BLOCK = ["seq", "preorder_idx", "dom_depth", "slot_key", "ty", "level", "text", "value", "anchored_by", "norm_hash", "restyle_sig", "parent_slot"]


def revision_pairs(docs: DataFrame) -> DataFrame:
    """Successive revisions of each target: tid, from_rev, to_rev, hashes, counts, slots."""
    w = Window.partitionBy("tid").orderBy("rev")
    prior = {c: F.lag(c).over(w) for c in ("rev", "doc_hash", "block_count", "slots")}
    p = docs.withColumns({f"p_{c}": v for c, v in prior.items()}).filter("p_rev IS NOT NULL")
    return p.select("tid", F.col("p_rev").alias("from_rev"), F.col("rev").alias("to_rev"), F.col("p_doc_hash").alias("old_hash"), F.col("doc_hash").alias("new_hash"), F.col("p_block_count").alias("old_count"), F.col("block_count").alias("new_count"), "max_depth", F.col("p_slots").alias("old_slots"), F.col("slots").alias("new_slots"))


def sides(blocks: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of both revisions of each pair, as structs o and n, with how often their slot key occurs there."""
    out = []
    for rev, name in (("from_rev", "o"), ("to_rev", "n")):
        keys = changed.select("tid", "from_rev", "to_rev", F.col(rev).alias("rev"))
        b = blocks.join(keys, ["tid", "rev"]).select(*PAIR, F.struct(*_BLOCK).alias(name), F.col("slot_key").alias("slot"))
        out.append(b.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "slot"))))
    return out[0], out[1]


def anchor_align(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of slot keys that are unique on both sides, and what is left of either side."""
    both = old.filter("times = 1").drop("times").join(new.filter("times = 1").drop("times"), [*PAIR, "slot"], "full_outer")
    anchors = both.filter("o IS NOT NULL AND n IS NOT NULL").select(*PAIR, "o", "n")
    rest = lambda side, whole: both.filter(f"{'n' if side == 'o' else 'o'} IS NULL").select(*PAIR, side).unionByName(whole.filter("times > 1").select(*PAIR, side))
    return anchors, rest("o", old), rest("n", new)


def moved_anchors(anchors: DataFrame) -> DataFrame:
    """Old places of anchors that moved: runs of MOVED_RUN or more, next to each other in old order, off a longest increasing spine."""
    w = Window.partitionBy(*PAIR).orderBy("o_seq")
    a = anchors.select(*PAIR, F.col("o.seq").alias("o_seq"), F.col("n.seq").alias("n_seq"))
    inverted = a.withColumn("back", F.lag("n_seq").over(w) > F.col("n_seq")).groupBy(*PAIR).agg(F.bool_or("back").alias("any")).filter("any").select(*PAIR)

    def off(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o_seq").reset_index(drop=True)
        rows["off"] = True
        rows.loc[increasing(rows["n_seq"].tolist()), "off"] = False
        return rows[[*PAIR, "o_seq", "off"]]

    kinds = ", ".join(f"{c} {a.schema[c].dataType.simpleString()}" for c in (*PAIR, "o_seq"))
    flagged = a.join(inverted, PAIR, "left_semi").groupBy(*PAIR).applyInPandas(off, f"{kinds}, off boolean")
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*PAIR, "off").orderBy("o_seq"))
    runs = flagged.withColumn("island", island).filter("off")
    return runs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "island"))).filter(F.col("n") >= MOVED_RUN).select(*PAIR, "o_seq")


def exact_residual(old: DataFrame, new: DataFrame) -> DataFrame:
    """Residual blocks of equal text, in order of place. An old block meets the first new one still unused; if their types
    differ, the new one stays free for the next.

    Where all blocks of a text have one type, that pairs equal ranks. Other texts are folded, by places and types alone.
    """
    key = [*PAIR, "h"]
    rank = lambda df, s: df.withColumns({"h": F.col(f"{s}.norm_hash"), "t": F.col(f"{s}.ty")}).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(f"{s}.seq")))
    o, n = rank(old, "o"), rank(new, "n")
    places = o.select(*key, "t", F.lit(0).alias("side"), "k").unionByName(n.select(*key, "t", F.lit(1).alias("side"), "k"))
    shape = places.groupBy(*key).agg((F.min("t") != F.max("t")).alias("mixed"), (F.min("side") != F.max("side")).alias("both"))
    mixed = places.join(shape.filter("mixed AND both").select(*key), key, "left_semi")
    kinds = ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in key)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        olds, news = rows[rows["side"] == 0], rows[rows["side"] == 1]
        got = first_unused(olds["t"].tolist(), news["t"].tolist())
        out = olds.iloc[[i for i, _ in got]][[*key, "k"]]
        return out.assign(n_k=news["k"].to_numpy()[[j for _, j in got]])

    folded = mixed.groupBy(*key).applyInPandas(fold, f"{kinds}, k int, n_k int")
    same = o.join(shape.filter("NOT mixed AND both").select(*key), key, "left_semi").join(n.select(*key, "k", "n"), [*key, "k"]).select(*PAIR, "o", "n")
    rest = o.join(folded, [*key, "k"]).drop("k").join(n.select(*key, F.col("k").alias("n_k"), "n"), [*key, "n_k"]).select(*PAIR, "o", "n")
    return same.unionByName(rest)


def window_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Residual pairs of one type at most WINDOW places apart: an equi-join on buckets of places, each old block in three."""
    o = old.withColumn("bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("o.seq") / (WINDOW + 1)) + d))).withColumn("ty", F.col("o.ty"))
    n = new.withColumn("bucket", F.floor(F.col("n.seq") / (WINDOW + 1))).withColumn("ty", F.col("n.ty"))
    return o.join(n, [*PAIR, "ty", "bucket"]).filter(F.abs(F.col("o.seq") - F.col("n.seq")) <= WINDOW).select(*PAIR, "o", "n")


def minhash_bands(text: Column) -> Column:
    """struct(seed, low) for each seed over the distinct words; none for a text without words."""
    words = F.array_distinct(word_tokens(text))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda s: F.struct(s.alias("seed"), F.array_min(F.transform(words, lambda w: F.xxhash64(w, s))).alias("low"))))


def minhash_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Residual pairs that share a MinHash bucket of 2 to MAX_BUCKET blocks of both sides together."""
    each = lambda df, s: df.withColumn("m", F.explode(minhash_bands(F.col(f"{s}.text")))).select(*PAIR, "m", s)
    o, n = each(old, "o"), each(new, "n")
    size = o.select(*PAIR, "m").unionByName(n.select(*PAIR, "m")).groupBy(*PAIR, "m").count().filter(F.col("count").between(2, MAX_BUCKET)).drop("count")
    return o.join(size, [*PAIR, "m"], "left_semi").join(n, [*PAIR, "m"]).filter("o.ty = n.ty").select(*PAIR, "o", "n")


def affinity(o: Column, n: Column) -> Column:
    part = F.when(o["ty"] == n["ty"], 0.6).otherwise(0.0) + F.when(o["anchored_by"] == n["anchored_by"], 0.2).otherwise(0.0) + F.when(o["level"].eqNullSafe(n["level"]), 0.2).otherwise(0.0)
    return F.when(o["slot_key"] == n["slot_key"], 1.0).otherwise(part)


def similar_places(old: DataFrame, new: DataFrame) -> DataFrame:
    """Greedy one-to-one matches of residual blocks: o_seq, n_seq, sim. The candidates are those of window_candidates and
    minhash_candidates; blocks without type, place or text have none.

    Each block is shuffled once, and its words are hashed behind the shuffle; equality of words is by 64-bit hashes.
    """
    each = lambda df, s, side: df.select(*PAIR, F.lit(side).alias("side"), *[F.col(f"{s}.{c}").alias(c) for c in ("seq", "ty", "slot_key", "anchored_by", "level", "text")])
    both = each(old, "o", 0).unionByName(each(new, "n", 1)).filter(" AND ".join(f"{c} IS NOT NULL" for c in (*PAIR, "seq", "text")))
    both = both.repartition(*PAIR).sortWithinPartitions(*PAIR, "side", "seq")
    hashed = both.select(*PAIR, "side", "seq", "ty", "slot_key", "anchored_by", "level", F.transform(word_tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    kinds = {c: both.schema[c].dataType.simpleString() for c in (*PAIR, "seq")}
    return hashed.mapInArrow(similar_blocks, ", ".join([*(f"{c} {kinds[c]}" for c in PAIR), f"o_seq {kinds['seq']}", f"n_seq {kinds['seq']}", "sim float"]))


def similar_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The blocks of similar_places with their similarity."""
    at = lambda df, s: df.select(*PAIR, F.col(f"{s}.seq").alias(f"{s}_seq"), s)
    return similar_places(old, new).join(at(old, "o"), [*PAIR, "o_seq"]).join(at(new, "n"), [*PAIR, "n_seq"]).select(*PAIR, "o", "n", "sim")


def _numbers(o: Column, n: Column) -> tuple[Column, Column]:
    pick = lambda b: F.when(b["ty"] == "price", b["value"]["minor"].cast("double")).when(b["ty"] == "number", b["value"]["num"].cast("double"))
    return pick(o), pick(n)


def noise(ct: Column, ty: Column, before: Column, after: Column, changed: Column) -> Column:
    """How likely a change is noise. changed: the words that differ, as one text, or null."""
    same = (F.lower(collapse(before)) == F.lower(collapse(after))) & (before != after)
    digits = changed.rlike(r"\d") & ~changed.rlike(r"(?U)\p{L}")
    key = lambda t: F.contains(t, F.lit(":")) & (F.size(F.split(F.trim(F.substring_index(t, ":", 1)), r"\s+")) <= 5) & F.lower(F.substring_index(t, ":", 1)).rlike("|".join(KEY_WORDS))
    short = F.size(F.split(F.trim(after), r"\s+")) <= 5
    modified = F.when(ty.isin("price", "number", "date"), 0.0).when(same, 1.0).when(digits & (key(after) | key(before)), 0.0).when(digits & F.lower(after).rlike("|".join(CUE_WORDS)), 0.85).when(digits & short, 0.6).otherwise(0.05)
    return F.when(ct == "reordered", 0.9).when(ct == "restyled", 0.95).when(ct.isin("added", "removed"), F.when(ty == "link", 0.6).otherwise(0.0)).otherwise(modified).cast("float")


def units(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Change units of all pairs whose doc_hash differs, before cascades are gathered."""
    changed = pairs.filter("old_hash <> new_hash")
    old, new = (settled(x, "side") for x in sides(blocks, changed))
    anchors, left, right = anchor_align(old, new)
    anchors, left, right = settled(anchors, "anchors"), settled(left, "left"), settled(right, "right")
    moved = moved_anchors(anchors).withColumn("moved", F.lit(True))
    anchors = anchors.withColumn("o_seq", F.col("o.seq")).join(moved, [*PAIR, "o_seq"], "left").drop("o_seq")
    same = (F.col("o.text") == F.col("n.text")) & F.col("o.value").eqNullSafe(F.col("n.value"))
    ct = F.when(~same, "modified").when(F.col("o.restyle_sig") != F.col("n.restyle_sig"), "restyled").when(F.col("moved"), "reordered")
    from_anchors = anchors.withColumn("ct", ct).filter("ct IS NOT NULL").select(*PAIR, "o", "n", "ct", F.lit(1.0).cast("float").alias("sim"))
    exact = settled(exact_residual(left, right), "exact")
    gone = lambda df, s, used: df.withColumn("q", F.col(f"{s}.seq")).join(used.select(*PAIR, F.col(f"{s}.seq").alias("q")), [*PAIR, "q"], "left_anti").drop("q")
    left, right = settled(gone(left, "o", exact), "left"), settled(gone(right, "n", exact), "right")
    similar = settled(similar_pairs(left, right), "similar")
    removed, added = gone(left, "o", similar), gone(right, "n", similar)
    block = blocks.select(F.struct(*_BLOCK).alias("x")).schema["x"].dataType
    none = F.lit(None).cast(block)
    u = from_anchors.unionByName(exact.select(*PAIR, "o", "n", F.lit("reordered").alias("ct"), F.lit(1.0).cast("float").alias("sim")))
    u = u.unionByName(similar.select(*PAIR, "o", "n", F.lit("modified").alias("ct"), "sim"))
    u = u.unionByName(removed.select(*PAIR, "o", none.alias("n"), F.lit("removed").alias("ct"), F.lit(0.0).cast("float").alias("sim")))
    u = u.unionByName(added.select(*PAIR, none.alias("o"), "n", F.lit("added").alias("ct"), F.lit(0.0).cast("float").alias("sim")))
    return described(u)


def described(u: DataFrame) -> DataFrame:
    """Deltas, magnitudes and noise of pairs o, n with ct and sim."""
    o, n = F.col("o"), F.col("n")
    before, after = _numbers(o, n)
    modified = F.col("ct") == "modified"
    u = u.withColumns({"num_from": F.when(modified & before.isNotNull() & after.isNotNull(), before), "num_to": F.when(modified & before.isNotNull() & after.isNotNull(), after)})
    u = u.withColumn("num_pct", (F.col("num_to") - F.col("num_from")) / F.greatest(F.abs("num_from"), F.lit(1e-9)))
    links = modified & (o["ty"] == "link") & (n["ty"] == "link") & ~o["value"]["href"].eqNullSafe(n["value"]["href"])
    enc = F.when(F.col("num_from").isNotNull() | links, "val").when(modified, "idiff").when(F.col("ct") == "restyled", "val").when(F.col("ct") == "reordered", "move").otherwise("block")
    u = u.withColumn("enc", enc)
    # Only prose that was modified meets the token diff; other rows carry nulls through it.
    prose = F.col("enc") == "idiff"
    u = u.withColumn("ops", inline_diff_udf(F.when(prose, o["text"]), F.when(prose, n["text"])))
    u = u.withColumn("ops", F.when(prose, F.coalesce("ops", F.array().cast("array<array<string>>"))))
    val = lambda b: F.when(links, F.coalesce(b["value"]["href"], F.lit(""))).otherwise(b["text"])
    shown = F.when(F.col("ct") == "added", n["text"]).otherwise(o["text"])
    a = F.when(F.col("enc") == "val", val(n)).when(F.col("enc") == "block", F.left(shown, F.lit(TEXT_CAP)))
    delta = F.struct(
        F.col("enc").alias("enc"), a.alias("a"), F.when(F.col("enc") == "val", val(o)).alias("b"), F.when((F.col("enc") == "block") & (F.length(shown) > TEXT_CAP), True).alias("atrunc"), F.col("ops"),
        F.when(F.col("enc") == "move", o["preorder_idx"]).alias("from"), F.when(F.col("enc") == "move", n["preorder_idx"]).alias("to"), F.when(F.col("enc") == "move", n["slot_key"]).alias("key"),
        *[F.lit(None).cast("int").alias(c) for c in ("added", "removed", "modified", "truncated")], F.lit(None).cast("array<string>").alias("sample"),
    )
    count = lambda x: F.greatest(F.lit(1), F.size(F.filter(tokens(x[1]), lambda t: ~t.rlike(r"(?U)^\s+$")))).cast("double")
    total = F.aggregate("ops", F.lit(0.0), lambda s, x: s + count(x))
    edited = F.aggregate(F.filter("ops", lambda x: x[0] != "="), F.lit(0.0), lambda s, x: s + count(x))
    text_mag = F.when(F.size("ops") == 0, 0.0).otherwise(1 - F.exp(-3 * edited / total))
    magnitude = F.when(F.col("num_from").isNotNull(), F.least(F.abs("num_pct"), F.lit(1.0))).when(links, 1.0).when(prose, text_mag).when(F.col("ct").isin("added", "removed"), 1.0).otherwise(0.0)
    diffs = F.when(prose, F.array_join(F.transform(F.filter("ops", lambda x: x[0] != "="), lambda x: x[1]), " "))
    ty = F.coalesce(n["ty"], o["ty"])
    u = u.withColumns({"delta": delta, "magnitude": magnitude.cast("float"), "block_type": ty, "slot_key": F.coalesce(n["slot_key"], o["slot_key"]), "parent_slot": F.when(F.col("ct") == "removed", o["parent_slot"]).otherwise(F.coalesce(n["parent_slot"], o["parent_slot"]))})
    u = u.withColumn("noise", noise(F.col("ct"), ty, F.coalesce(o["text"], F.lit("")), F.coalesce(n["text"], F.lit("")), F.coalesce(diffs, F.lit(""))))
    event_key = F.sha2(F.concat_ws("\x1f", "tid", "slot_key", F.coalesce(o["norm_hash"].cast("string"), F.lit("")), F.coalesce(n["norm_hash"].cast("string"), F.lit(""))), 256)
    place = lambda f: F.when(F.col("ct") == "removed", 0).otherwise(F.coalesce(n[f], F.lit(0)))
    return u.select(*PAIR, "slot_key", "ct", "sim", "delta", "noise", "magnitude", "num_from", "num_to", "num_pct", "block_type", "parent_slot", o["text"].alias("old_text"), n["text"].alias("new_text"), o["value"]["dt"].alias("old_date"), n["value"]["dt"].alias("new_date"), place("dom_depth").alias("depth"), place("preorder_idx").alias("idx"), F.coalesce(n["anchored_by"], o["anchored_by"]).alias("anchored_by"), event_key.alias("event_key"))


def clustered(u: DataFrame) -> DataFrame:
    """More than MAX_CHILDREN changed children of one container become one unit of the container, which loses its own."""
    group = [*PAIR, "parent_slot"]
    big = u.filter("parent_slot IS NOT NULL").groupBy(*group).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("ct") == "added").alias("added"), F.count_if(F.col("ct") == "removed").alias("removed"), F.avg("magnitude").alias("magnitude"), F.avg("noise").alias("noise"), F.mode("block_type", True).alias("block_type"), F.min("anchored_by").alias("anchored_by"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("noise", "slot_key", F.to_json("delta").alias("d")))), 1, SAMPLE), lambda x: x["d"]).alias("sample"),
    ).filter(F.col("members") > MAX_CHILDREN)
    changed = F.col("members") - F.col("added") - F.col("removed")
    ct = F.when((F.col("removed") > 0) & (F.col("added") == 0) & (changed == 0), "removed").when((F.col("added") > 0) & (F.col("removed") == 0) & (changed == 0), "added").otherwise("modified")
    shape = u.schema["delta"].dataType
    field = {"enc": F.lit("struct"), "added": F.col("added").cast("int"), "removed": F.col("removed").cast("int"), "modified": changed.cast("int"), "truncated": (F.col("members") - F.size("sample")).cast("int"), "sample": F.col("sample")}
    delta = F.struct(*[field.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
    made = {"slot_key": F.col("parent_slot"), "ct": ct, "sim": F.lit(1.0), "delta": delta, "noise": F.col("noise"), "magnitude": F.col("magnitude"), "block_type": F.col("block_type"), "anchored_by": F.col("anchored_by"), "depth": F.lit(0), "idx": F.lit(0), "event_key": F.sha2(F.concat_ws("\x1f", "tid", "parent_slot", F.array_join("sample", "")), 256)}
    rows = big.select(*[(F.col(f.name) if f.name in PAIR else made.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) if f.name != "delta" else delta.alias("delta") for f in u.schema.fields])
    keys = big.select(*group)
    out = u.join(keys, group, "left_anti").select(*u.columns)
    out = out.join(keys.withColumnRenamed("parent_slot", "slot_key"), [*PAIR, "slot_key"], "left_anti").select(*u.columns)
    return out.unionByName(rows)
