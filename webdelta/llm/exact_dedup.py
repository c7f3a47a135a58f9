"""Exact dedup: 128-bit content hashes, one row kept per text, bytes compared inside groups.

Texts are grouped by (hash, bytes) with partial aggregation, so equal hashes of different bytes stay apart and a group of
copies of any size reaches its task as one row per map task. Rows learn their group by the hash pair (128 bits, SHA-256)
from a table of groups; the fewer than HOT groups that hold more than one in HOT of all rows are joined by broadcast.

Defined results: a null text counts as empty. Null ids are ignored when the id to stay is chosen; a group of null ids only
keeps null. Rows that repeat both id and text count in group_size and share one flag; `deduplicated` returns one of them.
An empty table gives an empty result. Other columns, whatever their names, are untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webdelta.llm.common import joined_with_hot, stored, text_of, whole_row


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per distinct text: hash (16 bytes), sha, keep_id, group_size."""
    text = text_of(docs, text_col)
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(docs[id_col].alias("id"), F.unhex(F.md5(text)).alias("hash"), text.alias("bytes"))
    by_bytes = rows.groupBy("hash", "bytes").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return by_bytes.select("hash", F.sha2("bytes", 256).alias("sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    found = stored(groups(docs, id_col, text_col, keep), "groups")
    total = found.agg(F.sum("group_size")).first()[0] or 0
    text = text_of(docs, text_col)
    rows = stored(docs.select(docs[id_col].alias("id"), F.unhex(F.md5(text)).alias("hash"), F.sha2(text, 256).alias("sha")), "hashes")
    both = joined_with_hot(rows, found, ["hash", "sha"], "group_size", total)
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with docs' own columns. Of rows that repeat id and text, one stays."""
    found = groups(docs, id_col, text_col, keep).select(F.col("keep_id").alias("k_id"), F.col("sha").alias("k_sha"))
    rows = docs.select(docs[id_col].alias("id"), F.sha2(text_of(docs, text_col), 256).alias("sha"), whole_row(docs).alias("row"))
    kept = rows.join(found, rows["id"].eqNullSafe(found["k_id"]) & (rows["sha"] == found["k_sha"]), "left_semi")
    plain = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    one = Window.partitionBy("id", "sha").orderBy(F.xxhash64(*plain))
    return kept.withColumn("n", F.row_number().over(one)).filter("n = 1").select("row.*")
