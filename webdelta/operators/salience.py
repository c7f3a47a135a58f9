"""Change units to scores, bands, categories, actions and confidence: closed-form expressions over a unit's columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdelta.functions.values import first_date, half_up2
from webdelta.operators.diff import PAIR
from webdelta.operators.packs import ACTION_COST, SIGNALS, Pack

#: How much a signal can add, words that turn a meaning, and the closed vocabulary of categories.
ALPHA = {"type": 0.6, "mag": 0.7, "num": 0.9, "date": 0.85, "neg": 1.0, "pos": 0.5, "kw": 0.95}
NEG_WORDS = ["no longer", "deprecated", "removed", "unsupported", "sold out", "end-of-life", "breaking", "required"]
CATEGORIES = ["price_increase", "price_decrease", "plan_added", "plan_removed", "availability_in", "availability_out", "api_breaking", "api_deprecation", "api_addition", "version_bump", "incident_open", "incident_update", "incident_resolved", "content_edit", "cosmetic"]
MATERIALITY = ["none", "low", "medium", "high", "critical"]
TOP_UNITS = 5
f = lambda x: F.lit(float(x)).cast("float")


def noisy_or(parts: list[Column]) -> Column:
    """1 - product of (1 - part), parts clamped to 0 .. 1, in float."""
    one = lambda p: f(1) - F.greatest(f(0), F.least(f(1), p.cast("float")))
    return (f(1) - reduce(lambda a, b: (a * b).cast("float"), map(one, parts))).cast("float")


def band(score: Column, pack: Pack) -> Column:
    out = F.lit("none")
    for name in ("low", "medium", "high", "critical"):
        out = F.when(score >= f(pack.bands[name]), name).otherwise(out)
    return out


def rank_of(value: Column, order: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), value).cast("int") - 1


def side_texts(u: DataFrame) -> DataFrame:
    """present and prior: the texts of either side that a delta shows."""
    d = F.col("delta")
    ops = lambda drop: F.array_join(F.transform(F.filter(d["ops"], lambda x: x[0] != drop), lambda x: x[1]), "")
    present = F.when(d["enc"].isin("val", "block"), d["a"]).when(d["enc"] == "idiff", ops("-"))
    prior = F.when(d["enc"].isin("val", "block"), d["b"]).when(d["enc"] == "idiff", ops("+"))
    return u.withColumns({"present": F.coalesce(present, F.lit("")), "prior": F.coalesce(prior, F.lit(""))})


def signals(u: DataFrame, pack: Pack) -> dict[str, Column]:
    """The seven signals of units with max_depth and block_count of the new document."""
    weights = F.create_map(*[F.lit(x) for k, v in pack.type_weight.items() for x in (k, float(v))])
    days = F.abs(F.datediff(F.coalesce("new_date", first_date(F.col("present"))), F.coalesce("old_date", first_date(F.col("prior")))))
    new, old, added = F.lower("present"), F.lower("prior"), F.lower(F.array_join(F.transform(F.filter(F.coalesce(F.col("delta.ops"), F.array().cast("array<array<string>>")), lambda x: x[0] == "+"), lambda x: x[1]), " "))
    neg = reduce(lambda a, b: a | b, [F.contains(added, F.lit(w)) | (F.contains(new, F.lit(w)) & ~F.contains(old, F.lit(w))) for w in NEG_WORDS])
    share = lambda a, b: F.when(F.coalesce(b, F.lit(0)) == 0, 1.0).otherwise(1 - a.cast("double") / b)
    text = F.when(F.col("present") != "", F.col("present")).otherwise(F.col("prior"))
    kw = F.lit(0.0)
    for r in reversed(pack.rules):
        kw = F.when(text.rlike(r["match"]), r["weight"]).otherwise(kw)
    return {
        "type": F.coalesce(F.element_at(weights, F.col("block_type")), F.lit(0.2)), "mag": F.col("magnitude"), "num": F.coalesce(F.least(F.abs("num_pct"), F.lit(1.0)), F.lit(0.0)),
        "date": F.coalesce(F.when(days > 0, 1 - F.exp(-days / 30.0)), F.lit(0.0)), "neg": F.when(neg, 1.0).otherwise(0.0), "pos": 0.5 * share(F.col("depth"), F.col("max_depth")) + 0.5 * share(F.col("idx"), F.col("block_count")), "kw": kw,
    }


def category(pack: Pack) -> Column:
    """By the first rule with a category on either side, then a price's direction, then words of removal, then shape."""
    low = F.lower("present")
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    out = F.when(F.col("ct").isin("reordered", "restyled"), "cosmetic").otherwise("content_edit")
    words = F.when(has(["deprecated", "end-of-life", "sunset"]), "api_deprecation").when(has(["removed", "no longer", "unsupported", "breaking"]), "api_breaking").otherwise("content_edit")
    out = F.when(has(NEG_WORDS), words).otherwise(out)
    price = (F.col("block_type") == "price") & F.col("num_from").isNotNull()
    out = F.when(price, F.when(F.col("num_to") > F.col("num_from"), "price_increase").when(F.col("num_to") < F.col("num_from"), "price_decrease").otherwise("content_edit")).otherwise(out)
    for r in reversed([r for r in pack.rules if r["cat"]]):
        out = F.when(F.col("present").rlike(r["match"]) | F.col("prior").rlike(r["match"]), r["cat"]).otherwise(out)
    return F.when(out.isin(CATEGORIES), out).otherwise("content_edit")


def action(pack: Pack) -> tuple[Column, Column]:
    """Action and what decided it: a sticky rule, the costliest matched rule, the category's row above band none, the band."""
    out, by = F.lit(pack.band_action["none"]), F.lit("band")
    for m, a in pack.band_action.items():
        out = F.when(F.col("mat") == m, a).otherwise(out)
    for cat, act in pack.cats.items():
        hit = (F.col("mat") != "none") & (F.col("cat") == cat)
        out, by = F.when(hit, act).otherwise(out), F.when(hit, "rule").otherwise(by)
    acting = [r for r in pack.rules if r["action"]]
    for r in sorted(acting, key=lambda r: ACTION_COST.index(r["action"])):
        hit = F.col("present").rlike(r["match"])
        out, by = F.when(hit, r["action"]).otherwise(out), F.when(hit, "rule").otherwise(by)
    for r in reversed([r for r in acting if r["sticky"]]):
        hit = F.col("present").rlike(r["match"])
        out, by = F.when(hit, r["action"]).otherwise(out), F.when(hit, "rule").otherwise(by)
    return out, by


def confidence(align_rate: Column, tier: str = "http") -> Column:
    fetch = {"http": 1.0, "api": 1.0, "rss": 0.95, "headless": 0.85}[tier]
    clean = F.when(F.col("anchored_by") == "anchor", f(1)).otherwise(f(0.9))
    align = F.when(F.col("ct").isin("added", "removed") | (F.col("sim") >= 1 - 1e-6), clean).otherwise(F.col("sim"))
    match = F.when(F.col("delta.enc") == "idiff", F.least(f(1), F.col("sim") / f(0.62))).otherwise(f(1))
    parse = F.when(F.col("block_type").isin("price", "number"), F.when(F.col("num_from").isNotNull(), f(0.97)).otherwise(f(0.7))).when(F.col("block_type") == "date", f(0.97)).otherwise(f(1))
    stable = F.when(align_rate < f(0.9), f(0.6)).otherwise(f(1))
    return F.greatest(f(0), F.least(f(1), (f(fetch) * align * match * parse * stable).cast("float")))


def scored(u: DataFrame, pairs: DataFrame, pack: Pack) -> DataFrame:
    """Units with score (raw), sal, mat, cat, act, decided_by, conf and the signals as an array of (name, value, part)."""
    removed = F.sum((F.col("ct") == "removed").cast("int")).over(Window.partitionBy(*PAIR))
    x = side_texts(u).join(pairs.select(*PAIR, "max_depth", "old_count", F.col("new_count").alias("block_count")), PAIR)
    x = x.withColumn("align_rate", F.when(F.col("old_count") > 0, 1 - removed / F.col("old_count")).otherwise(1.0).cast("float"))
    s = signals(x, pack)
    x = x.withColumns({f"s_{k}": (v * F.lit(float(pack.signals[k]))).cast("float") for k, v in s.items()})
    parts = {k: (f(ALPHA[k]) * F.col(f"s_{k}")).cast("float") for k in SIGNALS}
    x = x.withColumn("base", noisy_or(list(parts.values())))
    x = x.withColumn("score", (F.col("base") * (f(1) - F.col("noise"))).cast("float"))
    x = x.withColumns({"sal": half_up2(F.col("score")), "mat": band(F.col("score"), pack), "cat": category(pack)})
    act, by = action(pack)
    x = x.withColumns({"act": act, "decided_by": by, "conf": half_up2(confidence(F.col("align_rate")))})
    order = lambda a, b: F.when(a["part"] > b["part"], -1).when(a["part"] < b["part"], 1).when(a["name"] < b["name"], -1).otherwise(1)
    why = F.array_sort(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"s_{k}").alias("value"), parts[k].alias("part")) for k in SIGNALS]), order)
    return x.withColumn("signals", why).drop(*[f"s_{k}" for k in SIGNALS], "old_count")


def page_scores(s: DataFrame) -> DataFrame:
    """One score per pair: the noisy-or of its TOP_UNITS highest units."""
    w = Window.partitionBy(*PAIR).orderBy(F.col("score").desc(), "slot_key")
    top = s.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= TOP_UNITS).groupBy(*PAIR).agg(F.array_sort(F.collect_list("score"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("all"))
    return top.select(*PAIR, half_up2(f(1) - F.aggregate("all", f(1), lambda p, x: (p * (f(1) - x)).cast("float"))).alias("page_score"))
