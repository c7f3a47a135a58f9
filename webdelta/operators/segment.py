"""Nodes to typed blocks with text-free identities, in window functions over one observation's document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdelta.functions import values
from webdelta.functions.text import normal_attrs, normal_text
from webdelta.sources.html import nodes

DOC = ["tid", "rev"]
CRUMB = "›"
ROLES = {**{f"h{i}": "heading" for i in range(1, 7)}, "table": "table", "p": "paragraph", "li": "list_item", "pre": "code", "code": "code", "a": "link"}
RESTYLE = {"del": 1, "s": 1, "strike": 1, "ins": 2}


def framed(*parts: Column) -> Column:
    """A key of parts that no other split of the same characters gives."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256), 1, 24)


def normalized(pages: DataFrame, strip_text: list[str] = (), strip_attrs: list[str] = ()) -> DataFrame:
    """Node rows with normal text (not inside code) and attributes; `stripped` counts the attributes that went."""
    n = nodes(pages)
    kept = normal_attrs(F.col("attrs"), list(strip_attrs))
    return n.withColumns({"text": F.when(F.col("in_code"), F.col("text")).otherwise(normal_text(F.col("text"), list(strip_text))), "stripped": F.when(F.col("tag").isNotNull(), F.size("attrs") - F.size(kept)), "attrs": kept})


def heading_path(level: Column, text: Column, order: Column, window) -> Column:
    """The texts of the open headings before a row: a heading of level n closes those of level n and deeper."""
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(level == i, F.struct(order.alias("o"), text.alias("t"))), True).over(before) for i in range(1, 7)]
    live = [F.when(last[i].isNotNull() & (last[i]["o"] > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(x["o"], F.lit(-1)) for x in last[:i]])), last[i]["t"]) for i in range(6)]
    return F.array_compact(F.array(*live))


def override_for(attrs: Column, types: dict[str, str]) -> Column:
    """A type by the last simple token of a profile's keys: #id first, then class tokens in order."""
    if not types:
        return F.lit(None).cast("string")
    by_id = {k.split()[-1][1:]: v for k, v in types.items() if k.split()[-1].startswith("#")}
    by_class = {k.split()[-1].lstrip("."): v for k, v in types.items() if not k.split()[-1].startswith("#")}
    pick = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("string")
    tokens = F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+")
    of_class = F.get(F.array_compact(F.transform(tokens, lambda c: pick(by_class, c))), F.lit(0))
    return F.coalesce(pick(by_id, attrs["id"]), of_class)


def typed(b: DataFrame) -> DataFrame:
    """ty by inference (price before date before number, only in free text) and value, an all-nullable struct."""
    free = F.col("ty").isin("paragraph", "text", "list_item", "link") & F.col("forced").isNull()
    b = b.withColumns({"p": values.price(F.col("text")), "d": values.date(F.col("text")), "n": values.number(F.col("text"))})
    ty = F.when(F.col("forced").isNotNull(), F.col("forced")).when(free & F.col("p").isNotNull(), "price").when(free & F.col("d").isNotNull(), "date").when(free & F.col("n").isNotNull(), "number").otherwise(F.col("ty"))
    b = b.withColumn("ty", ty)
    value = F.struct(
        F.col("ty").alias("kind"), F.when(F.col("ty") == "price", F.col("p.minor")).alias("minor"), F.when(F.col("ty") == "price", F.col("p.currency")).alias("currency"), F.when(F.col("ty") == "price", F.col("p.period")).alias("period"),
        F.when(F.col("ty") == "date", F.col("d")).alias("dt"), F.when(F.col("ty") == "number", F.col("n")).alias("num"), F.when(F.col("ty") == "table_row", F.col("cells")).alias("cells"), F.when(F.col("ty") == "link", F.col("attrs")["href"]).alias("href"),
    )
    return b.withColumn("value", value).drop("p", "d", "n")


def keyed(b: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Adds breadcrumb, section ordinals, slot_key, block_id, norm_hash to rows with seq, place, level, ty, text, anchor."""
    doc = [*DOC, *extra]
    by_seq = Window.partitionBy(*doc).orderBy("seq")
    b = b.withColumn("crumbs", heading_path(F.when(F.col("ty") == "heading", F.col("level")), F.col("text"), F.col("seq"), by_seq))
    b = b.withColumn("section", F.sum((F.col("ty") == "heading").cast("int")).over(by_seq.rowsBetween(Window.unboundedPreceding, -1)))
    b = b.withColumn("anchored_by", F.when(F.coalesce(F.col("anchor"), F.lit("")) != "", "anchor").otherwise("struct"))
    nth = Window.partitionBy(*doc, F.coalesce("section", F.lit(0)), "ty", "anchored_by").orderBy("preorder_idx")
    b = b.withColumn("ordinal", F.when(F.col("ty") == "heading", 0).otherwise(F.row_number().over(nth) - 1))
    slot = F.when(F.col("anchored_by") == "anchor", framed(F.lit("anchor"), F.col("anchor"))).otherwise(framed(F.lit("struct"), F.array_join("crumbs", CRUMB), F.col("ty"), F.col("ordinal")))
    return b.withColumns({"slot_key": slot, "norm_hash": F.xxhash64("text")}).withColumn("block_id", framed(F.col("slot_key"), F.col("norm_hash")))


def blocks(pages: DataFrame, types: dict[str, str] | None = None, strip_text: list[str] = (), strip_attrs: list[str] = ()) -> DataFrame:
    """extracted() pages to blocks: seq, preorder_idx, dom_depth, slot_key, block_id, ty, level, text, value, anchored_by, norm_hash, restyle_sig, parent_slot."""
    n = normalized(pages, strip_text, strip_attrs)
    order = Window.partitionBy(*DOC).orderBy("pre")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("tag"))
    n = n.withColumn("role", role)
    n = n.withColumn("top", F.col("role").isNotNull() & (F.coalesce(F.max(F.when(F.col("role").isNotNull(), F.col("end"))).over(before), F.lit(-1)) < F.col("pre")))
    n = n.withColumn("b", F.last(F.when(F.col("top"), F.struct("pre", "end", "role")), True).over(so_far)).withColumn("b", F.when(F.col("pre") <= F.col("b.end"), F.col("b")))
    style = F.element_at(F.create_map(*[F.lit(x) for kv in RESTYLE.items() for x in kv]), F.col("tag"))
    inside = n.filter("b IS NOT NULL").withColumn("style", style)
    word = F.when((F.col("tag").isNull()) & (F.coalesce(F.col("text"), F.lit("")) != ""), F.struct("pre", "text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), " ")
    carried = F.struct("depth", "attrs", "tag")
    own = inside.groupBy(*DOC, F.col("b.pre").alias("at"), F.col("b.role").alias("ty")).agg(joined(word).alias("text"), F.bit_or(F.coalesce("style", F.lit(0))).alias("restyle_sig"), F.first(F.when(F.col("pre") == F.col("b.pre"), carried), True).alias("el"))
    own = own.select(*DOC, "at", F.lit(None).cast("int").alias("row"), "ty", "text", "restyle_sig", "el", F.lit(None).cast("array<string>").alias("cells"))
    # Table rows: every row of a top table that is in no other row; cells are its direct td and th.
    table = inside.filter(F.col("b.role") == "table")
    heads = table.filter((F.col("tag") == "tr") & (F.size("rows") == 0)).select(*DOC, F.col("pre").alias("row"), carried.alias("el"))
    words = table.filter((F.size("rows") > 0)).select(*DOC, F.col("b.pre").alias("at"), F.col("rows")[0]["row"].alias("row"), F.col("rows")[0]["cell"].alias("cell"), word.alias("w"), "style")
    cells = words.groupBy(*DOC, "at", "row", "cell").agg(joined(F.col("w")).alias("text"), F.min("w.pre").alias("pre"), F.bit_or(F.coalesce("style", F.lit(0))).alias("restyle_sig"))
    tr = cells.groupBy(*DOC, "at", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pre", "text")))), lambda x: x["text"]), " ").alias("text"), F.bit_or("restyle_sig").alias("restyle_sig"), F.transform(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "text")))), lambda x: x["text"]).alias("cells"))
    tr = tr.join(heads, [*DOC, "row"]).select(*DOC, "at", "row", F.lit("table_row").alias("ty"), "text", "restyle_sig", "el", "cells")
    b = own.unionByName(tr).filter((F.col("text") != "") | F.col("ty").isin("heading", "table"))
    level = F.when(F.col("ty") == "heading", F.substring("el.tag", 2, 1).cast("int"))
    b = b.select(*DOC, "at", "row", "ty", "text", "restyle_sig", "cells", level.alias("level"), F.col("el.depth").alias("dom_depth"), F.col("el.attrs").alias("attrs"), F.col("el.attrs")["id"].alias("anchor"), override_for(F.col("el.attrs"), types or {}).alias("forced"))
    b = typed(b.withColumn("forced", F.when(~F.col("ty").isin("heading", "table", "table_row"), F.col("forced"))))
    doc = Window.partitionBy(*DOC)
    # A table comes before its rows in sequence, and after them in numbering.
    b = b.withColumn("seq", F.row_number().over(doc.orderBy("at", F.coalesce("row", F.lit(-1)))) - 1)
    b = b.withColumn("preorder_idx", F.row_number().over(doc.orderBy("at", F.coalesce("row", F.lit(2**31 - 1)))) - 1)
    b = keyed(b)
    b = b.withColumn("parent_slot", F.when(F.col("row").isNotNull(), F.first(F.when(F.col("row").isNull(), F.col("slot_key")), True).over(Window.partitionBy(*DOC, "at"))))
    return b.select(*DOC, "seq", "preorder_idx", "dom_depth", "slot_key", "block_id", "ty", "level", "text", "value", "anchored_by", "norm_hash", F.col("restyle_sig").cast("tinyint").alias("restyle_sig"), "parent_slot")


def docs(b: DataFrame) -> DataFrame:
    """One row per observation with blocks: doc_hash over all that a reader can tell apart, block_count, max_depth."""
    frame = lambda c: F.concat(F.length(F.coalesce(c.cast("string"), F.lit(""))), F.lit(":"), F.coalesce(c.cast("string"), F.lit("")))
    row = F.concat(*[frame(c) for c in (F.col("slot_key"), F.col("ty"), F.col("level"), F.col("text"), F.to_json("value"), F.col("restyle_sig"), F.col("parent_slot"))])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.sha2(row, 256).alias("h")))), lambda x: x["h"]), "")
    return b.groupBy(*DOC).agg(F.substring(F.sha2(F.concat(F.lit("blocks-1"), whole), 256), 1, 32).alias("doc_hash"), F.count(F.lit(1)).alias("block_count"), F.max("dom_depth").alias("max_depth"), F.collect_set("slot_key").alias("slots"))
