"""Ignore rules over blocks: selectors drop, regular expressions redact, attributes lose their values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webdelta.operators.segment import DOC, framed

REDACTED = "￼"


def parsed_rules(rules: list[str]) -> list[tuple[str, str]]:
    """`selector:x`, `attr:x` and `regex:x` to pairs; a bare rule is a regular expression."""
    return [(k, v) if sep and k in ("selector", "attr", "regex") else ("regex", r) for r in rules for k, sep, v in [r.partition(":")]]


def masked(blocks: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """blocks after the rules (kind, value). `.class` selectors do nothing here; a bad expression is skipped."""
    if not rules:
        return blocks
    ids = [v[1:] for k, v in rules if k == "selector" and v.startswith("#")]
    tags = [v for k, v in rules if k == "selector" and v[:1] not in "#."]
    names = {"p": "paragraph", "li": "list_item", "table": "table", "tr": "table_row", "a": "link", "pre": "code", "code": "code", **{f"h{i}": "heading" for i in range(1, 7)}}
    gone = F.lit(False)
    if ids:
        gone = gone | F.col("slot_key").isin([_anchor_key(i) for i in ids])
    for t in tags:
        gone = gone | (F.col("ty") == names.get(t, t))
    marked = blocks.withColumn("gone", gone)
    dropped = marked.filter("gone").select(*DOC, F.col("slot_key").alias("parent_slot")).distinct()
    out = marked.filter("NOT gone").join(dropped, [*DOC, "parent_slot"], "left_anti").drop("gone").select(*blocks.columns)
    text = F.col("text")
    for k, v in rules:
        if k == "regex":
            try:
                re.compile(v)
            except re.error:
                continue
            text = F.regexp_replace(text, v, REDACTED)
    out = out.withColumn("text", text).withColumn("norm_hash", F.xxhash64("text")).withColumn("block_id", framed(F.col("slot_key"), F.col("norm_hash")))
    if any(k == "attr" and v in ("href", "src") for k, v in rules):
        out = out.withColumn("value", F.col("value").withField("href", F.lit(None).cast("string")))
    return out


def _anchor_key(anchor: str) -> str:
    import hashlib

    return hashlib.sha256(f"anchor\x1f{anchor}".encode()).hexdigest()[:24]
