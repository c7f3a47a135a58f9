"""Greedy one-to-one matching of similar blocks: one pair of revisions after the other, on the hashes of their words."""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW, MAX_BUCKET, SEEDS = 32, 32, 8
SIMILAR, SIMILAR_SHORT = 0.62, 0.75
#: Columns that name a pair of revisions.
KEY = 3
#: Of 64-bit xxHash.
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def lows(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of words, none empty, and each seed the least xxhash64(word, seed). The words are given as xxhash64(word)."""
    h, out = words.view(np.uint64), np.empty((len(starts), SEEDS), np.int64)
    for seed in range(SEEDS):
        x = (h + (_P5 + np.uint64(4))) ^ np.uint64(seed * int(_P1) % 2**64)
        x = (x << np.uint64(23) | x >> np.uint64(41)) * _P2 + _P3
        x ^= x >> np.uint64(33)
        x *= _P2
        x ^= x >> np.uint64(29)
        x *= _P3
        x ^= x >> np.uint64(32)
        out[:, seed] = np.minimum.reduceat(x.view(np.int64), starts)
    return out


def edits(x: list[int], y: list[int]) -> int:
    """Edit distance, by bit vectors over the longer side."""
    if len(x) < len(y):
        x, y = y, x
    lo, hi = 0, 0
    while lo < len(y) and x[lo] == y[lo]:
        lo += 1
    while hi < len(y) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if not y:
        return len(x)
    places: dict[int, int] = {}
    for i, t in enumerate(x):
        places[t] = places.get(t, 0) | 1 << i
    full, last = (1 << len(x)) - 1, 1 << len(x) - 1
    up, down, score = full, 0, len(x)
    for t in y:
        eq = places.get(t, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | (full & ~(h | up)), up & h
        score += 1 if more & last else -1 if less & last else 0
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(v | more)), more & v
    return score


class Blocks:
    """Blocks of whole pairs of revisions: rows of a pair stand together, the old side first, each by place."""

    def __init__(self, t: pa.Table):
        column = lambda c: pa.concat_arrays(t[c].chunks)
        codes = lambda c: pc.fill_null(column(c).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).tolist()
        self.seq = column("seq").to_numpy(zero_copy_only=False).tolist()
        self.ty, self.slot, self.anchored_by, self.level = (codes(c) for c in ("ty", "slot_key", "anchored_by", "level"))
        self.least = np.where(pc.fill_null(pc.equal(column("ty"), "table_row"), False).to_numpy(zero_copy_only=False), SIMILAR_SHORT, SIMILAR)
        words = column("words")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        self.start, self.end, self.words = (ends - sizes).tolist(), ends.tolist(), np.ascontiguousarray(words.flatten().to_numpy(zero_copy_only=False))
        least = np.empty((len(sizes), SEEDS), np.int64)
        if len(self.words):
            least[sizes > 0] = lows(self.words, (ends - sizes)[sizes > 0])
        self.lows = [c.tolist() for c in least.T]
        for i in np.flatnonzero(sizes == 0).tolist():
            for c in self.lows:
                c[i] = None

    def kind(self, i: int) -> tuple[int, bytes]:
        """Type and words in order."""
        return self.ty[i], self.words[self.start[i] : self.end[i]].tobytes()

    def affinity(self, i: int, j: int) -> float:
        """diff.affinity of blocks of one type."""
        if self.slot[i] == self.slot[j] != -1:
            return 1.0
        return 0.6 + (0.2 if self.anchored_by[i] == self.anchored_by[j] != -1 else 0.0) + (0.2 if self.level[i] == self.level[j] else 0.0)

    def matches(self, a: int, c: int, b: int) -> Iterator[tuple[int, int, float]]:
        """Places and similarity of the greedy matches of the old blocks a to c with the new ones c to b, of one pair of revisions."""
        seq = self.seq
        # Blocks further apart meet in MinHash buckets, whose sizes count all blocks of both sides. Those without type match none.
        sizes = [Counter(x[a:b]) for x in self.lows] if seq[b - 1] - seq[a] > WINDOW or seq[c - 1] - seq[c] > WINDOW else []
        buckets = lambda i: [(s, x[i]) for s, (n, x) in enumerate(zip(sizes, self.lows)) if x[i] is not None and n[x[i]] <= MAX_BUCKET]
        olds, news = ([i for i in side if self.ty[i] >= 0] for side in (range(a, c), range(c, b)))
        if len(set(seq[a:c])) == c - a and len(set(seq[c:b])) == b - c:
            # Only equal words in equal order and full affinity give 1.0 as a float, so those come first, by place.
            same: dict[tuple[int, bytes], list[int]] = {}
            for j in news:
                same.setdefault(self.kind(j), []).append(j)
            gone = set()
            for i in olds:
                if not (js := same.get(self.kind(i))):
                    continue
                wide = bool(buckets(i))
                for k in range(0 if wide else bisect_left(js, seq[i] - WINDOW, key=seq.__getitem__), len(js)):
                    j = js[k]
                    if not wide and seq[j] > seq[i] + WINDOW:
                        break
                    if j not in gone and self.affinity(i, j) == 1.0:
                        gone.update((i, j))
                        yield seq[i], seq[j], 1.0
                        break
            olds, news = ([i for i in side if i not in gone] for side in (olds, news))
        else:
            # A place that is held several times: equal blocks of it are one.
            olds, news = (list({(seq[i], self.slot[i], self.anchored_by[i], self.level[i], self.kind(i)): i for i in side}.values()) for side in (olds, news))
        if olds and news:
            yield from self.lazily(olds, news, buckets)

    def lazily(self, olds: list[int], news: list[int], buckets) -> Iterator[tuple[int, int, float]]:
        """Greedy matches by falling similarity, then place. A distance is computed only where the pair's bound is reached
        while both its places are free."""
        seq = self.seq
        words = {i: self.words[self.start[i] : self.end[i]].tolist() for side in (olds, news) for i in side}
        sets = {i: frozenset(w) for i, w in words.items()}
        places = [seq[j] for j in news]
        far: dict[tuple[int, int], list[int]] = {}
        for j in news:
            for k in buckets(j):
                far.setdefault(k, []).append(j)

        def sim(i: int, j: int, both: int, distance: int) -> float:
            union, most = len(sets[i]) + len(sets[j]) - both, max(len(words[i]), len(words[j]))
            jac = both / union if union else 1.0
            return 0.55 * jac + 0.30 * (1 - (distance / most if most else 0.0)) + 0.15 * self.affinity(i, j)

        at_o, at_n, bounds = array("q"), array("q"), array("d")
        for i in olds:
            x, n, least = sets[i], len(words[i]), self.least[i] - 1e-6
            lo, hi = bisect_left(places, seq[i] - WINDOW), bisect_right(places, seq[i] + WINDOW)
            for j in {*news[lo:hi], *(j for k in buckets(i) for j in far.get(k, ()))}:
                if self.ty[i] != self.ty[j]:
                    continue
                y, both = sets[j], len(x & sets[j])
                bound = sim(i, j, both, max(abs(n - len(words[j])), len(x) - both, len(y) - both))
                if bound >= least:
                    at_o.append(i), at_n.append(j), bounds.append(bound)
        if not bounds:
            return
        bound = np.frombuffer(bounds, np.float64).astype(np.float32)
        used_o, used_n, known = set(), set(), []

        def settled(above: float) -> Iterator[tuple[int, int, float]]:
            """Takes known pairs of more than so much."""
            while known and -known[0][0] > above:
                s, o, n = heappop(known)
                if o not in used_o and n not in used_n:
                    used_o.add(o), used_n.add(n)
                    yield o, n, -s

        for k in map(int, np.argsort(-bound, kind="stable")):
            yield from settled(float(bound[k]))
            i, j = at_o[k], at_n[k]
            if seq[i] in used_o or seq[j] in used_n:
                continue
            s = float(np.float32(sim(i, j, len(sets[i] & sets[j]), edits(words[i], words[j]))))
            if s >= self.least[i]:
                heappush(known, (-s, seq[i], seq[j]))
        yield from settled(-1.0)


def _cuts(held: pa.RecordBatch | None, batch: pa.RecordBatch) -> np.ndarray:
    """Rows of the batch that begin another pair of revisions than the row before, which for the first is the last one held."""
    out = np.zeros(batch.num_rows, bool)
    for c in range(KEY):
        x = pa.concat_arrays([*([] if held is None else [held.column(c).slice(held.num_rows - 1)]), batch.column(c)])
        out[held is None :] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out)


def _of_pairs(t: pa.Table) -> pa.RecordBatch:
    """Matches of a table of whole pairs of revisions."""
    t = t.combine_chunks()
    b, side = Blocks(t), t["side"].to_numpy()
    edges = [0, *_cuts(None, t.to_batches()[0]).tolist(), t.num_rows]
    at, found = [], []
    for lo, hi in zip(edges, edges[1:]):
        mid = lo + int(np.searchsorted(side[lo:hi], 1))
        if lo < mid < hi:
            found += b.matches(lo, mid, hi)
            at += [lo] * (len(found) - len(at))
    o, n, sim = zip(*found) if found else ((), (), ())
    keys = t.select(t.column_names[:KEY]).take(pa.array(at, pa.int64()))
    place = t.schema.field("seq").type
    columns = [*(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in keys.columns), pa.array(o, place), pa.array(n, place), pa.array(sim, pa.float32())]
    return pa.RecordBatch.from_arrays(columns, [*keys.column_names, "o_seq", "n_seq", "sim"])


def similar_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of blocks that come by pair of revisions, side (0 old, 1 new) and place. Rows of a pair may run over batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = _cuts(held[-1] if held else None, batch)
        if not len(cuts):
            held.append(batch)
            continue
        last = int(cuts[-1])
        whole = [*held, batch.slice(0, last)]
        held = [batch.slice(last)]
        yield _of_pairs(pa.Table.from_batches(whole))
    if held:
        yield _of_pairs(pa.Table.from_batches(held))
