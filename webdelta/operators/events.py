"""Scored units to change events: segments, summaries, the redesign guard, the salience gate, the size ceiling, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdelta.functions.text import jaccard
from webdelta.operators.diff import PAIR
from webdelta.operators.packs import Pack
from webdelta.operators.salience import MATERIALITY, f, rank_of
from webdelta.operators.segment import DOC

CEILING, ANCHOR_CAP, LABEL_CAP, SUMMARY_CAP, CUT_TEXT = 8192, 160, 240, 160, 600
LOW_OVERLAP = 0.3
SEPARATOR = " › "
#: The role that an event names for a block type, exit codes, and their order, worst last.
ROLE = {"price": "price", "date": "date", "number": "meta", "heading": "prose", "link": "link", "code": "code", "table_row": "table-cell", "table": "table-cell", "paragraph": "prose", "list_item": "prose", "text": "prose"}
EXIT = {"no_change": 0, "changed": 10, "baseline": 11, "below_gate": 12, "usage": 1, "not_found": 2, "fetch_error": 3, "robots": 4, "auth": 5, "rate_limited": 6, "render_needed": 7}
SEVERITY = ["no_change", "baseline", "below_gate", "changed", "fetch_error", "rate_limited", "robots", "auth", "render_needed", "not_found", "usage"]


def capped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def segment_index(blocks: DataFrame) -> DataFrame:
    """tid, rev, slot_key, anchor, label_path, role. The path holds at most level - 1 headings above a heading of a level."""
    by_seq = Window.partitionBy(*DOC).orderBy("seq")
    so_far, before = (by_seq.rowsBetween(Window.unboundedPreceding, last) for last in (Window.currentRow, -1))
    # A heading of level l comes to place min(places before + 1, l): t + min(0, min(l - t)) over headings, t their number.
    heading = F.col("ty") == "heading"
    b = blocks.withColumn("nth", F.count_if(heading).over(so_far))
    b = b.withColumn("place", F.when(heading, F.col("nth") + F.least(F.lit(0), F.min(F.when(heading, F.col("level") - F.col("nth"))).over(so_far))))
    # Places grow by one at most, so an entry stands if no heading after it came to a place above.
    last = [F.last(F.when(F.col("place") == i, F.struct(F.col("nth").alias("o"), F.col("text").alias("t"))), True).over(before) for i in range(1, 7)]
    b = b.withColumns({f"h{i}": x for i, x in enumerate(last)})
    standing = lambda i: F.col(f"h{i}.o") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"h{j}.o", F.lit(-1)) for j in range(i)])
    path = F.array_compact(F.array(*[F.when(standing(i), F.col(f"h{i}.t")) for i in range(6)]))
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("ty"))
    b = b.withColumns({"path": path, "role": role})
    own = F.when(F.col("ty") == "heading", F.col("text")).otherwise(F.col("role"))
    anchor = F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(F.col("text"))
    b = b.select(*DOC, "slot_key", "seq", F.left(anchor, F.lit(ANCHOR_CAP)).alias("anchor"), F.left(F.array_join(F.concat("path", F.array(own)), SEPARATOR), F.lit(LABEL_CAP)).alias("label_path"), "role")
    return b.groupBy(*DOC, "slot_key").agg(F.max_by(F.struct("anchor", "label_path", "role"), "seq").alias("seg"))


def summary(label: Column) -> Column:
    d, pct = F.col("delta"), F.col("num_pct") * 100
    way = F.when(F.col("num_to") > F.col("num_from"), "rose").otherwise("fell")
    numeric = F.concat(label, F.lit(" "), way, F.lit(" "), F.format_string("%.1f", pct), F.lit("% ("), d["b"], F.lit("→"), d["a"], F.lit(")."))
    total = d["added"] + d["removed"] + d["modified"]
    rows = F.concat(total.cast("string"), F.lit(" rows changed (+"), d["added"].cast("string"), F.lit("/-"), d["removed"].cast("string"), F.lit("/~"), d["modified"].cast("string"), F.lit(")."))
    text = F.when(F.col("num_from").isNotNull(), numeric).when(d["enc"] == "val", F.concat(label, F.lit(" "), d["b"], F.lit("→"), d["a"], F.lit("."))).when(d["enc"] == "block", F.concat(label, F.lit(" added."))).when(d["enc"] == "struct", rows).otherwise(F.concat(label, F.lit(" "), F.col("cat"), F.lit(".")))
    return capped(text, SUMMARY_CAP)


def redesigned(pairs: DataFrame) -> DataFrame:
    """Pairs whose slot keys hardly overlap: tid, revs, detail."""
    share = jaccard(F.col("new_slots"), F.col("old_slots"))
    zero = F.coalesce(F.size("new_slots"), F.lit(0)) == 0
    low = pairs.withColumn("overlap", share).filter((F.size("old_slots") > 0) & (zero | (F.col("overlap") < LOW_OVERLAP)) & (F.col("old_hash") != F.col("new_hash")))
    return low.select(*PAIR, F.when(zero, "the selector/extraction matched zero blocks").otherwise(F.format_string("only %.0f%% slot-key overlap with the prior observation", F.col("overlap") * 100)).alias("detail"))


def assembled(s: DataFrame, pairs: DataFrame, pages: DataFrame, segments: DataFrame, pack: Pack, min_salience: str = "low", event_prefix: str = "cfe_") -> DataFrame:
    """Events, one row each: tid, from_rev, to_rev, mat, sal, score, event_key, event (a struct in wire order)."""
    guard = redesigned(pairs)
    text = F.concat(F.lit("page structure changed substantially ("), F.col("detail"), F.lit("); diff suppressed and target flagged for operator review"))
    kept = s.join(guard.select(*PAIR), PAIR, "left_anti").filter(rank_of(F.col("mat"), MATERIALITY) >= MATERIALITY.index(min_salience))
    kept = kept.join(segments.withColumnRenamed("rev", "to_rev"), ["tid", "to_rev", "slot_key"], "left")
    kept = kept.withColumn("seg", F.coalesce("seg", F.struct(F.lit("").alias("anchor"), F.col("cat").alias("label_path"), F.lit("meta").alias("role"))))
    kept = kept.withColumn("summary", summary(F.when(F.col("seg.anchor") == "", F.col("seg.role")).otherwise(F.col("seg.anchor")))).withColumn("fp", F.substring("slot_key", 1, 12))
    shape = s.schema["delta"].dataType
    fill = {"enc": F.lit("block"), "a": text}
    whole = guard.select(
        *PAIR, F.lit("modified").alias("ct"), F.struct(*[fill.get(x.name, F.lit(None).cast(x.dataType)).alias(x.name) for x in shape.fields]).alias("delta"), F.lit("high").alias("mat"), f(0.75).alias("sal"), f(0.75).alias("score"), F.lit("content_edit").alias("cat"), F.lit("re_run_downstream").alias("act"), f(0.6).alias("conf"),
        F.struct(F.lit("").alias("anchor"), F.lit("page").alias("label_path"), F.lit("meta").alias("role")).alias("seg"), capped(text, SUMMARY_CAP).alias("summary"), F.lit("").alias("fp"), F.lit("").alias("slot_key"), F.sha2(F.concat_ws("\x1f", *PAIR), 256).alias("event_key"),
    )
    columns = [*PAIR, "ct", "delta", "mat", "sal", "score", "cat", "act", "conf", "seg", "summary", "fp", "slot_key", "event_key"]
    rows = kept.select(*columns).unionByName(whole.select(*columns))
    meta = pages.select("tid", "rev", "url", "obs", "title")
    rows = rows.join(meta.withColumnRenamed("rev", "to_rev"), ["tid", "to_rev"]).join(meta.select("tid", F.col("rev").alias("from_rev"), F.col("obs").alias("base_obs")), ["tid", "from_rev"])
    rows = rows.join(pairs.select(*PAIR, "old_hash", "new_hash"), PAIR)
    # The pair, the event's key and its place among equal keys name an event in all runs and pairs.
    nth = F.row_number().over(Window.partitionBy(*PAIR, "event_key").orderBy("slot_key", "ct")) - 1
    name = F.substring(F.sha2(F.concat_ws("\x1f", *PAIR, "event_key", nth), 256), 1, 26)
    none = lambda: F.lit(None).cast("string")
    event = F.struct(
        F.lit("1").alias("v"), F.concat(F.lit(event_prefix), name).alias("id"), F.struct("url", "tid", "title").alias("src"), F.col("obs"), F.struct(F.col("base_obs").alias("obs"), F.concat(F.lit("sha:"), "old_hash").alias("snap"), F.col("from_rev").alias("rev")).alias("base"),
        F.array(F.struct(F.col("seg.anchor").alias("anchor"), "fp", F.col("seg.label_path").alias("label_path"), F.col("seg.role").alias("role"))).alias("seg"), F.col("ct"), F.col("delta"), F.struct("sal", "mat", "cat", "summary").alias("why"), F.struct(F.col("act"), none().alias("tgt")).alias("followup"), F.col("conf"),
        F.struct(F.lit("http").alias("m"), F.concat(F.lit("sha:"), "new_hash").alias("hash"), F.lit(pack.stamp()).alias("pack")).alias("prov"),
    )
    return under_ceiling(rows.withColumn("event", event)).select(*PAIR, "slot_key", "ct", "mat", "sal", "score", "cat", "act", "conf", "summary", "event_key", "event")


def event_json(event: Column) -> Column:
    """Minified, keys in wire order, without nulls."""
    return F.to_json(event)


def under_ceiling(rows: DataFrame) -> DataFrame:
    """Events of more than CEILING bytes keep a bounded delta: a struct its counts, its samples counted as truncated; any other
    becomes a block of both sides' first CUT_TEXT characters, marked atrunc."""
    big = F.octet_length(event_json(F.col("event"))) > CEILING
    d = F.col("event.delta")
    ops = lambda drop: F.array_join(F.transform(F.filter(d["ops"], lambda x: x[0] != drop), lambda x: x[1]), "")
    sides = {"a": F.when(d["enc"] == "idiff", ops("-")).otherwise(d["a"]), "b": F.when(d["enc"] == "idiff", ops("+")).otherwise(d["b"])}
    block = {"enc": F.lit("block"), "a": F.left(F.coalesce(sides["a"], F.lit("")), F.lit(CUT_TEXT)), "b": F.nullif(F.left(sides["b"], F.lit(CUT_TEXT)), F.lit("")), "atrunc": F.lit(True)}
    rest = {"sample": F.array().cast("array<string>"), "truncated": F.coalesce(d["truncated"], F.lit(0)) + F.coalesce(F.size(d["sample"]), F.lit(0))}
    shape = rows.schema["event"].dataType["delta"].dataType
    built = lambda given, keep: F.struct(*[given.get(x.name, d[x.name] if keep else F.lit(None)).cast(x.dataType).alias(x.name) for x in shape.fields])
    slim = F.when(d["enc"] == "struct", built(rest, True)).otherwise(built(block, False))
    return rows.withColumn("event", F.when(big, F.col("event").withField("delta", slim)).otherwise(F.col("event")))


def envelopes(events: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per observation: tid, rev, kind (baseline, no_change, changed), exit_code, events (JSON array, by place in the event order)."""
    got = events.groupBy("tid", F.col("to_rev").alias("rev")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot_key", "ct", "event_key", event_json(F.col("event")).alias("j")))), lambda x: x["j"]).alias("events"))
    first = F.col("rev") == F.min("rev").over(Window.partitionBy("tid"))
    out = pages.select("tid", "rev", "url", "obs").join(got, ["tid", "rev"], "left").withColumn("first", first)
    kind = F.when(F.col("first"), "baseline").when(F.col("events").isNotNull(), "changed").otherwise("no_change")
    code = F.when(kind == "baseline", EXIT["baseline"]).when(kind == "changed", EXIT["changed"]).otherwise(EXIT["no_change"])
    return out.select("tid", "rev", "url", "obs", kind.alias("kind"), code.alias("exit_code"), F.coalesce("events", F.array().cast("array<string>")).alias("events"))


def worst_code(codes: DataFrame) -> DataFrame:
    """Of exit codes by run (column run, exit_code), the one that a run over many targets ends with."""
    order = [EXIT[k] for k in SEVERITY]
    return codes.groupBy("run").agg(F.max_by("exit_code", F.array_position(F.array(*[F.lit(x) for x in order]), F.col("exit_code"))).alias("exit_code"))
