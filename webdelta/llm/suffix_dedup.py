"""Suffix-array dedup: bytes of strings that repeat in the corpus, by merging shard Burrows-Wheeler transforms.

Every string of `length` bytes (a window) has one anchor: its k-gram with the smallest hash, the leftmost of equals. Equal
windows have equal anchors at equal places, so only windows whose anchor occurs twice in the corpus can repeat, and windows
of different anchors never meet. Consecutive windows of one anchor form a piece. Pieces of anchors that occur once are never
read; equal pieces are one, with a count, before anything is shuffled; pieces of one anchor go to one task.

There the pieces are cut into shards, each with its own suffix order and Burrows-Wheeler transform, and the transforms are
merged by iterative interleave refinement: in round i the suffixes of all shards, interleaved by the bytes of i - 1 rounds,
are dealt stably by the STEP bytes before them, and each entry moves to the row of that place (LF, STEP times). The boundary
between two neighbours appears in the round that their common prefix ends in; intervals of one suffix are settled and leave.
Only suffixes that `length` bytes of their piece precede are dealt. What is left after the last round are the intervals of
suffixes with a common prefix of `length` bytes: the windows that repeat. No suffixes are sorted across shards.
An anchor with more than HOT_PIECES different pieces (a frequent line in many surroundings) is split: its pieces are cut into
parts of LEVELS windows in a row by the anchor's place in the window, and the bytes that all windows of a part share, by
which equal windows of different pieces have equal parts' routes, take the anchor's place. Equal parts are one again before
anything is merged, so the windows inside the line collapse, and parts that nothing else shares leave; parts that are still
hot are cut further, down to single windows, whose equals are one by their hash. No route that is merged has more than
HOT_PIECES pieces.

Defined results: null text is empty. Matches never cross documents. Rows that repeat id and text are copies of each other,
so all their bytes go where they are long enough. Null ids are ids. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdelta.llm.common import discard, joined_with_hot, slices, stored, text_of
from webdelta.llm.words import _BYTE, _power, mix

#: A byte that UTF-8 never has: the end of a piece.
END = 0xFF
#: Bytes of pieces that are merged at once, and of one shard of them; pieces of an anchor before it is split.
CHUNK, SHARD, HOT_PIECES = 1 << 20, 1 << 18, 1024
#: Windows of a part of a hot anchor's piece, level by level.
LEVELS = (20, 3, 1)
#: Bytes that a round of the merge refines by.
STEP = 8
_PLACE_BITS = 20


def anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, place of the anchor, its hash."""
    n = len(data)
    step = (1 << _PLACE_BITS) - length
    if n > step + length - 1:
        parts = [(a, anchors(data[a : a + step + length - 1], length, k)) for a in range(0, n - length + 1, step)]
        return tuple(np.concatenate([p[i] + (a if i in (0, 2) else 0) for a, p in parts]) for i in range(4))
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _power(n), dtype=np.uint64)])
    h = mix((total[k:] - total[:-k]) * _power(n - k + 1, True))
    place = np.uint64((1 << _PLACE_BITS) - 1)
    key = h & ~place | np.arange(len(h), dtype=np.uint64)
    w = length - k + 1
    blocks = np.full(-(-len(key) // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - length + 1
    at = (np.minimum(right[:m], left[w - 1 : w - 1 + m]) & place).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return first, np.diff(np.append(first, m)), at[first], h[at[first]]


def in_turn(*keys: np.ndarray) -> np.ndarray:
    """The stable order of rows by keys of whole numbers from 0, the first key first: one sort of keys and row in a word, where they fit."""
    n = len(keys[0])
    widths = [int(k.max()).bit_length() if n else 0 for k in keys]
    if sum(widths) + n.bit_length() > 63:
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.int64)
    for k, width in zip(keys, widths):
        packed = packed << width | k
    packed = packed << n.bit_length() | np.arange(n)
    packed.sort()
    return packed & ((1 << n.bit_length()) - 1)


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = wide[: len(text)] << np.uint64(56)
    for j in range(1, 8):
        key |= wide[j : len(text) + j] << np.uint64(56 - 8 * j)
    return key


def transform(text: np.ndarray, depth: int) -> np.ndarray:
    """A shard's transform, as its suffix order by the first `depth` bytes at least: the byte of a row is the text's before its place."""
    n = len(text)
    key = eights(text)
    order = np.argsort(key)
    start = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    done = 8
    while done < depth:
        tied = ~(start & np.append(start[1:], True))
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        pos = order[rows]
        after = np.where(pos + done < n, rank[np.minimum(pos + done, n - 1)] + 1, 0)
        group = rank[pos]
        by = in_turn(group, after)
        pos, after, group = pos[by], after[by], group[by]
        order[rows] = pos
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        start[rows] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, rows, 0))
        done *= 2
    return order


def repeated_suffixes(shards: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose next `length` bytes lie in their piece and occur at another place: shard, place, interval.

    Rows start at the windows' ends and move back STEP bytes a round: the deal is by the bytes before them, and LF, applied
    STEP times, is the row of the place so far before.
    """
    none = np.zeros(0, np.int64)
    if not shards:
        return none, none, none
    parts = [transform(s, length) for s in shards]
    base = np.cumsum([0] + [len(s) for s in shards])
    text = np.concatenate(shards)
    # Narrow numbers: the rounds read these tables at random.
    small = np.int32 if len(text) < 1 << 31 else np.int64
    place = np.concatenate([p + b for p, b in zip(parts, base[:-1])]).astype(small)
    row = np.empty(len(place), small)
    row[place] = np.arange(len(place), dtype=small)
    key, code, coded = eights(text), None, 0
    ends = np.flatnonzero(text == END)
    size = np.diff(np.concatenate([[-1], ends]))
    inside = np.arange(len(text)) - np.repeat(ends + 1 - size, size)
    rows = np.flatnonzero(inside[place] >= length)
    interval = np.zeros(len(rows), np.int64)
    done = 0
    while done < length and len(rows):
        step = min(STEP, length - done)
        if step != coded:
            # The strings of `step` bytes, numbered once for all rounds.
            code, coded = np.unique(key >> np.uint64(64 - 8 * step), return_inverse=True)[1].astype(small), step
        at = place[rows] - small(step)
        byte = code[at]
        order = in_turn(byte)
        rows, interval, byte = row[at[order]], interval[order], byte[order]
        bound = np.ones(len(rows) + 1, bool)
        bound[1:-1] = (byte[1:] != byte[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(bound[:-1])
        shared = ~(bound[:-1] & bound[1:])
        rows, interval = rows[shared], interval[shared]
        done += step
    at = place[rows]
    shard = np.searchsorted(base, at, side="right") - 1
    return shard, at - base[shard], interval


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the places, in order, of its windows that occur elsewhere in the pieces."""
    shards, of, held, size = [], [], [], 0
    for i, p in enumerate(pieces):
        held.append(i)
        size += len(p) + 1
        if size >= SHARD or i == len(pieces) - 1:
            shards.append(np.frombuffer(b"".join(pieces[j] + b"\xff" for j in held), np.uint8))
            of.append((np.array(held), np.cumsum([0] + [len(pieces[j]) + 1 for j in held])))
            held, size = [], 0
    shard, place, _ = repeated_suffixes(shards, length)
    out = [np.zeros(0, np.int64)] * len(pieces)
    for s, (ids, first) in enumerate(of):
        mine = np.sort(place[shard == s])
        at = np.searchsorted(first, mine, side="right") - 1
        edge = np.searchsorted(at, np.arange(len(ids) + 1))
        for j in np.unique(at).tolist():
            out[ids[j]] = mine[edge[j] : edge[j + 1]] - first[j]
    return out


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by [start, end)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are gone, so that the phases' files do not add up."""
    gc.collect()
    spark._jvm.System.gc()


def repeats(docs: DataFrame, length: int = 200, k: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Covered ranges, one row per piece or window that repeats: id, text_hash, start, end. Ranges may overlap."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text_of(docs, text_col)).alias("text_hash"), text_of(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def find(batches):
        for b in slices(batches):
            found = [anchors(np.frombuffer(t.encode(), np.uint8), length, k) for t in b.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(f[0]) for f in found]))
            first, count, place, h = (np.concatenate([f[i] for f in found]) for i in range(4))
            columns = [b.column("id").take(at), b.column("text_hash").take(at), pa.array(first), pa.array(count, pa.int32()), pa.array(place - first), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "first", "windows", "place", "anchor"])

    runs = stored(rows.filter(F.octet_length("text") >= length).mapInArrow(find, f"id {kind}, text_hash long, first long, windows int, place long, anchor long"), "anchors")
    twice = stored(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "twice")
    total = twice.agg(F.sum("n")).first()[0] or 0
    kept = joined_with_hot(runs, twice, ["anchor"], "n", total)
    per_doc = stored(kept.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first", "windows", "place", "anchor")).alias("runs")), "runs")
    _release(spark)

    def cut(batches):
        for b in slices(batches):
            out = {c: [] for c in ("id", "text_hash", "first", "windows", "place", "anchor", "piece", "key")}
            for i, t, runs_, doc, text_hash in zip(range(b.num_rows), b.column("text").to_pylist(), b.column("runs").to_pylist(), b.column("id").to_pylist(), b.column("text_hash").to_pylist()):
                data = t.encode()
                for r in runs_:
                    piece = data[r["first"] : r["first"] + r["windows"] - 1 + length]
                    for c, v in zip(out, (doc, text_hash, r["first"], r["windows"], r["place"], r["anchor"], piece, hashlib.blake2b(piece, digest_size=16).digest())):
                        out[c].append(v)
            kinds = (b.schema.field("id").type, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    left, right = rows.withColumnRenamed("id", "r_id").withColumnRenamed("text_hash", "r_hash"), per_doc
    both = left.join(right, left["r_id"].eqNullSafe(right["id"]) & (left["r_hash"] == right["text_hash"])).select("id", "text_hash", "text", "runs")
    pieces = stored(both.mapInArrow(cut, f"id {kind}, text_hash long, first long, windows int, place long, anchor long, piece binary, key binary"), "pieces")
    for old in (runs, twice, per_doc):
        discard(old)
    _release(spark)
    one = F.min(F.struct("anchor", "place", "windows", "piece")).alias("p")
    distinct = stored(pieces.groupBy("key").agg(one, F.count(F.lit(1)).alias("n")).select("key", F.col("p.anchor").alias("route"), "p.place", "p.windows", "p.piece", "n"), "distinct")
    _release(spark)

    def parts_of(width):
        def run(batches):
            for b in slices(batches, ("piece",), 1 << 20):
                out = [[], [], [], [], [], [], []]
                for parent, route_, place, windows, piece in zip(*(b.column(c).to_pylist() for c in ("key", "route", "place", "windows", "piece"))):
                    first = 0
                    while first < windows:
                        # Windows whose anchor lies at low, ..., low + width - 1 all hold the bytes between the last one's start and the first one's end.
                        low = (place - first) // width * width
                        n = min(windows - first, place - first - low + 1)
                        part, core = piece[first : first + n - 1 + length], piece[place - low : place - low - width + 1 + length]
                        to = hashlib.blake2b(b"%d %d " % (route_, low) + core, digest_size=8).digest()
                        for c, v in zip(out, (parent, first, int.from_bytes(to, "little", signed=True), place - first, n, part, hashlib.blake2b(part, digest_size=16).digest())):
                            c.append(v)
                        first += n
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["parent", "at", "route", "place", "windows", "piece", "key"])

        return run

    def merge(batches):
        keys, held, size, last = [], [], 0, None

        def done():
            out = [[], [], []]
            for key, places in zip(keys, repeated_windows(held, length)):
                for s, e in zip(*(x.tolist() for x in merged_spans(places, places + length))):
                    for c, v in zip(out, (key, s, e)):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64()))], ["key", "start", "end"])

        for b in slices(batches, ("piece",)):
            for route_, key, piece in zip(*(b.column(c).to_pylist() for c in ("route", "key", "piece"))):
                if size >= CHUNK and route_ != last:
                    yield done()
                    keys, held, size = [], [], 0
                keys.append(key)
                held.append(piece)
                size += len(piece)
                last = route_
        if held:
            yield done()

    level, levels, routed = distinct, [], None
    for width in (*LEVELS, None):
        by_route = stored(level.groupBy("route").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1"), "by-route")
        n_met, most = by_route.agg(F.sum("pieces"), F.max("pieces")).first()
        met = joined_with_hot(level, by_route, ["route"], "pieces", n_met or 0)
        some = met.filter(F.col("pieces") <= HOT_PIECES).select("route", "key", "piece")
        routed = some if routed is None else routed.unionByName(some)
        if (most or 0) <= HOT_PIECES:
            break
        hot = met.filter(F.col("pieces") > HOT_PIECES).select("key", "route", "place", "windows", "piece")
        parts = stored(hot.mapInArrow(parts_of(width), "parent binary, at long, route long, place long, windows int, piece binary, key binary"), "parts")
        level = parts.groupBy("key").agg(F.min(F.struct("route", "place", "windows", "piece")).alias("p"), F.count(F.lit(1)).alias("n"))
        level = stored(level.select("key", "p.route", "p.place", "p.windows", "p.piece", "n"), "distinct-parts")
        levels.append((parts.select("parent", "at", "key"), level))
    found = routed.repartition("route").sortWithinPartitions("route", "key").mapInArrow(merge, "key binary, start long, end long")
    # A piece, or a part, that occurs twice repeats as a whole.
    for table in [distinct, *(x for _, x in levels)]:
        found = found.unionByName(table.filter("n > 1").select("key", F.lit(0).cast("long").alias("start"), F.octet_length("piece").cast("long").alias("end")))

    def covered_by(found, table):
        return stored(found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).join(table.select("key", "n"), "key"), "covered")

    if levels:
        found = stored(found, "spans")
    for members, table in reversed(levels):
        up = joined_with_hot(members, covered_by(found, table), ["key"], "n", members.count()).select(F.col("parent").alias("key"), "at", F.explode("spans").alias("s"))
        found = stored(found.unionByName(up.select("key", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end")).distinct()), "spans")
    covered = covered_by(found, distinct)
    discard(distinct)
    _release(spark)
    n_pieces = pieces.count()
    out = joined_with_hot(pieces.select("key", "id", "text_hash", "first"), covered, ["key"], "n", n_pieces)
    return out.select("id", "text_hash", "first", F.explode("spans").alias("s")).select("id", "text_hash", (F.col("first") + F.col("s.start")).alias("start"), (F.col("first") + F.col("s.end")).alias("end"))


def without_repeats(docs: DataFrame, length: int = 200, k: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, spans (start and end of removed runs), kept_sha256, kept (remaining bytes)."""
    per_doc = repeats(docs, length, k, id_col, text_col).groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    per_doc = stored(per_doc, "found")
    _release(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("r_id"), F.xxhash64(text_of(docs, text_col)).alias("r_hash"), text_of(docs, text_col).alias("text"))
    both = rows.join(per_doc, rows["r_id"].eqNullSafe(per_doc["id"]) & (rows["r_hash"] == per_doc["text_hash"]), "left").select(F.col("r_id").alias("id"), "text", "found")

    def run(batches):
        for b in slices(batches):
            out = [[], [], [], [], [], []]
            for t, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                data = t.encode()
                a, e = merged_spans(np.array([x["start"] for x in found or []], np.int64), np.array([x["end"] for x in found or []], np.int64))
                edges = [0, *(x for pair in zip(a.tolist(), e.tolist()) for x in pair), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                for c, v in zip(out, (len(data), len(data) - len(kept), len(a), [{"start": x, "end": y} for x, y in zip(a.tolist(), e.tolist())], hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    kind = rows.schema["r_id"].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
