"""Sharding: a k-d tree over document metadata, cut at distributed weighted medians along the widest dimension.

Rows of equal text are one unit (a point), unless the unit is large: units above a PIECE-th of a shard are cut into pieces
by a hash of the id, so one hot text can fill many shards while a small group of copies stays in one. A node that must
become k shards is split into floor(k/2) and the rest, at the weighted quantile of its widest dimension: the spread between
its lowest and highest key over the spread of the whole table. Keys are 48 bits, 24 of the value and 24 of a hash that
breaks ties, so any cut can be met. Each cut is found by histograms of 4096 buckets, refined inside the bucket that holds
the quantile: the driver sees one bucket for each node, never the rows. Leaves have near equal bytes.

Dimensions: the text's length, its source and its language (places of their hashes), and the id's hash. A unit takes the
smallest of its rows' values, and nulls are 0.

Slots number a shard's rows from 0 in id order. Defined results: null text has no bytes and belongs with empty text; rows
that repeat everything get slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webdelta.llm.common import in_order, stored, text_of

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: A unit weighs at most this part of a shard.
PIECE = 64
BUCKET_BITS, KEY_BITS = 12, 48


def _key(value: Column, bits_hash: Column) -> Column:
    """value in 0 .. 2^24 - 1, with a hash below it."""
    return F.shiftleft(value.cast("long"), 24) + F.pmod(bits_hash, F.lit(1 << 24))


def units(rows: DataFrame, shards: int) -> DataFrame:
    """rows: id, size, text_hash, piece, source, lang. One row per unit: text_hash, piece, bytes, k0 .. k3."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 24))
    by = rows.groupBy("text_hash", "piece").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("length"), F.min(place("source")).alias("source"), F.min(place("lang")).alias("lang"), F.min(place("id")).alias("ids")
    )
    tie = F.xxhash64("text_hash", "piece")
    # The logarithm keeps the spread of lengths from resting on the longest text alone.
    length = F.floor(F.least(F.log2(F.col("length") + 1) / 40, F.lit(1.0)) * ((1 << 24) - 1))
    return by.select("text_hash", "piece", "bytes", *[_key(v, F.xxhash64(tie, F.lit(i))).alias(f"k{i}") for i, v in enumerate((length, F.col("source"), F.col("lang"), F.col("ids")))])


def kd_shards(points: DataFrame, shards: int, dims: int = 4) -> DataFrame:
    """points: bytes, k0 .. k{dims-1}, other columns. Adds `shard`, 0 to shards - 1."""
    keys = [f"k{i}" for i in range(dims)]
    points = points.withColumn("shard", F.lit(0))
    whole = points.agg(*[F.max(k) - F.min(k) for k in keys]).first()
    if whole[0] is None:
        return points
    spread = [max(1, w) for w in whole]
    nodes = {0: shards}  # first shard of each node, and how many it becomes
    while any(k > 1 for k in nodes.values()):
        open_ = {a: k for a, k in nodes.items() if k > 1}
        stats = {r["shard"]: r for r in points.filter(F.col("shard").isin(list(open_))).groupBy("shard").agg(F.sum("bytes").alias("bytes"), *[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        cuts = {}
        for a, k in open_.items():
            if a in stats:
                r = stats[a]
                widest = max(range(dims), key=lambda i: ((r[f"hi_k{i}"] - r[f"lo_k{i}"]) / spread[i], -i))
                cuts[a] = [widest, r["bytes"] * (k // 2) / k, 0, None]  # dimension, bytes still to the left, prefix, cut
        key = F.lit(None).cast("long")
        for a, c in cuts.items():
            key = F.when(F.col("shard") == a, F.col(keys[c[0]])).otherwise(key)
        keyed = points.select("shard", "bytes", key.alias("key")).filter("key IS NOT NULL")
        for step in range(KEY_BITS // BUCKET_BITS):
            if not (todo := {a: c for a, c in cuts.items() if c[3] is None}):
                break
            shift = KEY_BITS - BUCKET_BITS * (step + 1)
            inside = F.lit(False)
            for a, c in todo.items():
                inside = inside | ((F.col("shard") == a) & (F.shiftright("key", shift + BUCKET_BITS) == c[2]))
            buckets = keyed.filter(inside).groupBy("shard", F.shiftright("key", shift).alias("bucket")).agg(F.sum("bytes").alias("bytes"))
            run = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
            need = F.lit(None).cast("double")
            for a, c in todo.items():
                need = F.when(F.col("shard") == a, F.lit(float(c[1]))).otherwise(need)
            over = buckets.withColumn("upto", F.sum("bytes").over(run)).filter(F.col("upto") >= need)
            for r in over.groupBy("shard").agg(F.min_by(F.struct("bucket", "bytes", "upto"), "bucket").alias("b")).collect():
                a, b = r["shard"], r["b"]
                c = cuts[a]
                before = b["upto"] - b["bytes"]
                if step == KEY_BITS // BUCKET_BITS - 1 or b["bytes"] * 500 * shards <= whole_bytes(stats):
                    # Close enough: the bucket goes to the side that it overshoots less.
                    c[3] = (b["bucket"] + (b["upto"] - c[1] <= c[1] - before)) << shift
                else:
                    c[1], c[2] = c[1] - before, b["bucket"]
        to = F.col("shard")
        for a, c in cuts.items():
            if c[3] is not None:
                to = F.when((F.col("shard") == a) & (F.col(keys[c[0]]) >= F.lit(c[3])), F.lit(a + nodes[a] // 2)).otherwise(to)
        points = stored(points.withColumn("shard", to), "tree")
        nodes = {x: n for a, k in nodes.items() for x, n in (((a, k // 2), (a + k // 2, k - k // 2)) if k > 1 else ((a, k),))}
    return points


def whole_bytes(stats: dict) -> int:
    return sum(r["bytes"] for r in stats.values())


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot."""
    text = text_of(docs, text_col)
    rows = docs.select(
        docs[id_col].alias("id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text)).alias("text_hash"),
        docs[source_col].cast("string").alias("source"), docs[lang_col].cast("string").alias("lang"),
    )
    rows = stored(rows, "meta")
    whole = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, whole // (shards * PIECE))
    # A text whose copies weigh more than `most` is cut into pieces; there are at most shards * PIECE such texts.
    large = rows.groupBy("text_hash").agg(F.sum("size").alias("b")).filter(F.col("b") > most).select("text_hash", F.ceil(F.col("b") / most).cast("int").alias("pieces"))
    rows = rows.join(F.broadcast(large), "text_hash", "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("id"), F.col("pieces"))).otherwise(F.lit(0)).cast("int")).drop("pieces")
    rows = stored(rows, "pieces")
    points = kd_shards(stored(units(rows, shards), "units"), shards).select("text_hash", "piece", "shard")
    # No (text, piece) has many rows, so nothing is skewed here.
    placed = rows.join(points, ["text_hash", "piece"]).select("id", "size", "crc", "shard")
    out = in_order(placed, [F.col("shard"), F.col("id"), F.col("crc")], "slots", groups=F.col("shard"))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("rank").alias("slot"))
