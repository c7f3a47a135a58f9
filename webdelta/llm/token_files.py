"""Token-id files: frequency-ranked ids, variable-length bytes with separate control bytes, decoded by table lookup.

Ids are replaced by their rank by corpus frequency (ties: smaller id first), so common tokens take one byte. A block holds
whole documents in ascending id order; its payload is

    b"RVB1", n_docs, n_ids (32-bit little-endian), control bytes of all values, data bytes of all values

where the values are the documents' token counts and then the ranks. A control byte has two bits for each of four values:
its length less one. Blocks are rows of a Parquet table, so writes commit as a whole, survive lost executors and reach any
store that Spark writes; the rank table lies beside them. Each row also has its shard, place and ids before it in its shard.

Defined results: null text is empty and gets the end id only. Null ids come first; rows that repeat an id follow one another
in an order set by their tokens. An empty table gives no blocks. Other columns are not read.
"""

from __future__ import annotations

import array
import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webdelta.llm.bpe import Vocabulary
from webdelta.llm.common import discard, new_path, slices, stored
from webdelta.llm.words import _BYTE, _SPACE, _power, mix

MAGIC = b"RVB1"
#: Ids in a block before it is closed.
BLOCK_IDS = 1 << 18
#: Words in a worker's table (about 30 bytes each) before it is begun anew, words in a call to the library and in a text of a call.
TABLE, CALL, JOINED = 1_000_000, 4096, 64
#: Bytes of a word that is hashed, and of text that is hashed at once.
HASHED, BLOCK = 64, 1 << 20
#: What each byte of a plain word is: a letter (ASCII, or of U+00C0 to U+00FF), a digit, another printable ASCII character; 0 where a word
#: with it is not plain: an apostrophe may lead a contraction, "<" a special token, and U+00D7 and U+00F7 are no letters.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F], _KIND[0x30:0x3A] = 3, 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = 1
_KIND[[0x27, 0x3C, 0x97, 0xB7]] = 0
#: For each control byte the four lengths.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> bytes:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = n
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= n[:, None]]
    return control.astype(np.uint8).tobytes() + data.tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    """The n values of pack()."""
    held = -(-n // 4)
    length = LENGTHS[np.frombuffer(raw, np.uint8, held)].reshape(-1)[:n]
    data = np.frombuffer(raw, np.uint8, offset=held)
    end = np.cumsum(length, dtype=np.int64)
    if n and end[-1] != len(data):
        raise ValueError("token block is damaged")
    start = end - length
    out = data[start].astype("<u4")
    for k in (1, 2, 3):
        has = np.flatnonzero(length > k)
        out[has] |= data[start[has] + k].astype("<u4") << np.uint32(8 * k)
    return out


@functools.lru_cache(2)
def id_code(path: str, end_id: int) -> str:
    """The narrowest type that holds all ids of a tokenizer: what is shuffled and spilled is as small as can be."""
    return "<u2" if max(end_id, *Vocabulary(path).pieces) < 1 << 16 else "<u4"


class Library:
    """The tokenizers library over whole texts: each word between ASCII white space, across which this kind of tokenizer never
    joins, is encoded once. Words are found and hashed in numpy over a whole slice, and their ids gathered from a table that is
    sorted by 64-bit hash and of bounded size; only a slice's new words, and words over HASHED bytes, go to the library.

    The library costs less by text than by word, so new words go to it JOINED to a text. How many pre-tokens a plain word has is
    known from its bytes, and a pre-token's last id has the end-of-word suffix, so its ids are found by counting these. Other
    words go as lists, where the library names the word of each id but those of special tokens."""

    def __init__(self, path: str, code: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = Vocabulary(path)  # raises if it is another kind
        self.suffix = known.suffix
        self.last = np.zeros(max(end_id, *known.pieces) + 1, bool)
        self.last[[i for t, i in known.ids.items() if t.endswith(known.suffix)]] = True
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.code, self.end_id = code, end_id
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # The first id is the end id, which each text gets as its last word.
        self.flat = np.array([self.end_id], self.code)
        self._index()

    def _index(self) -> None:
        """Where each value of the leading bits starts in the table, so that a search looks at a row or two."""
        self.shift = np.uint64(64 - max(8, len(self.hashes).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << 64 - int(self.shift)))])

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The table's row of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        top = (h >> self.shift).astype(np.int64)
        row, stop, left = self.first[top], self.first[top + 1], np.arange(len(h))
        while True:
            some = np.flatnonzero(row < stop)
            if not len(some):
                return out
            row, stop, left = row[some], stop[some], left[some]
            hit = self.hashes[row] == h[left]
            out[left[hit]] = row[hit]
            some = np.flatnonzero(~hit)
            row, stop, left = row[some] + 1, stop[some], left[some]

    def _called(self, items: list, **how) -> list:
        return self.tokenizer.encode_batch_fast(items, add_special_tokens=False, **how)

    def _flat(self, found: list) -> np.ndarray:
        return np.array(array.array("I", itertools.chain.from_iterable(e.ids for e in found)), self.code)

    def _listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of a call, one after the other, and how many each has."""
        lists, ids, sizes = [words[a : a + JOINED] for a in range(0, len(words), JOINED)], [], []
        for e, some in zip(self._called(lists, is_pretokenized=True), lists):
            found, of = [e], e.word_ids
            if None in of:
                # A special token's id names no word.
                found = self._called(some)
                sizes.append(np.array([len(x) for x in found], np.int64))
            else:
                sizes.append(np.bincount(np.array(of, np.int64), minlength=len(some)))
            ids.append(self._flat(found))
        return np.concatenate(ids), np.concatenate(sizes)

    def _joined(self, words: list[bytes], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, of so many pre-tokens each."""
        ids = self._flat(self._called([b" ".join(words[a : a + JOINED]).decode() for a in range(0, len(words), JOINED)]))
        done, stop = np.flatnonzero(self.last[ids]) + 1, np.cumsum(parts)
        if len(done) != stop[-1] or done[-1] != len(ids):
            return self._listed([w.decode() for w in words])
        return ids, np.diff(done[stop - 1], prepend=0)

    def _encoded(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, where each word's begin, and how many it has."""
        flat, at, n, held = [np.zeros(0, self.code)], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), 0
        for a in range(0, len(start), CALL):
            words = [raw[x:y].tobytes() for x, y in zip(start[a : a + CALL].tolist(), end[a : a + CALL].tolist())]
            kind = _KIND[np.frombuffer(b" ".join(words) + b" ", np.uint8)]
            first = np.concatenate([[0], np.cumsum(end[a : a + CALL] - start[a : a + CALL] + 1)[:-1]])
            opens = (kind > 0) & ((kind == 2) | np.diff(kind, prepend=0).astype(bool))
            parts = np.add.reduceat(opens, first, dtype=np.int64)
            # The space behind it has no kind either.
            plain = (np.add.reduceat(kind == 0, first, dtype=np.int64) == 1) & bool(self.suffix)
            for some, joined in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
                if len(some):
                    mine = [words[x] for x in some.tolist()]
                    ids, m = self._joined(mine, parts[some]) if joined else self._listed([w.decode() for w in mine])
                    flat.append(ids)
                    at[a + some], n[a + some] = held + np.cumsum(m) - m, m
                    held += len(ids)
        return np.concatenate(flat), at, n

    def ids(self, texts: pa.Array) -> pa.Array:
        """Each text's ids and the end id."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        inside = np.zeros(len(raw) + 2, bool)
        np.logical_not(_SPACE[raw], out=inside[1:-1])
        # A text's first byte starts a word, and the byte before it ends one, whatever they are.
        cut = np.zeros(len(raw) + 1, bool)
        cut[edges] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        size = end - start
        h = np.zeros(len(start), np.uint64)
        short = size <= HASHED
        block = np.searchsorted(start, np.arange(0, len(raw) + BLOCK, BLOCK))
        for i, (a, b) in enumerate(zip(block[:-1].tolist(), block[1:].tolist())):
            part = raw[i * BLOCK : (i + 1) * BLOCK + HASHED]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _power(BLOCK + HASHED)[: len(part)], dtype=np.uint64)])
            on = a + np.flatnonzero(short[a:b])
            x = start[on] - i * BLOCK
            value = (total[x + size[on]] - total[x]) * _power(BLOCK + HASHED, True)[x]
            h[on] = mix(value + size[on].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        row = np.full(len(start), -1, np.int64)
        on = np.flatnonzero(short)
        row[on] = self._find(h[on])
        miss = on[row[on] < 0]
        if len(miss):
            fresh, one, of = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            got, place, n = self._encoded(raw, start[one], end[one])
            hashes = np.concatenate([self.hashes, fresh])
            order = np.argsort(hashes, kind="stable")
            moved = np.empty(len(order), np.int64)
            moved[order] = np.arange(len(order))
            row[miss] = len(self.hashes) + of
            row[on] = moved[row[on]]
            self.hashes = hashes[order]
            self.at = np.concatenate([self.at, len(self.flat) + place])[order]
            self.size = np.concatenate([self.size, n])[order]
            self.flat = np.concatenate([self.flat, got])
            self._index()
        at, n = self.at[row], self.size[row]
        flat, long = self.flat, np.flatnonzero(~short)
        if len(long):
            got, place, m = self._encoded(raw, start[long], end[long])
            at[long], n[long] = len(flat) + place, m
            flat = np.concatenate([flat, got])
        last = np.searchsorted(start, edges[1:])
        at, n = np.insert(at, last, 0), np.insert(n, last, 1)
        done = np.cumsum(n)
        out = flat[np.repeat(at - done + n, n) + np.arange(int(done[-1]) if len(done) else 0)]
        offsets = np.concatenate([[0], done[last + np.arange(len(last))]]) * out.itemsize
        if len(self.hashes) > TABLE:
            self._clear()
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


@functools.lru_cache(2)
def library(path: str, code: str, end_id: int) -> Library:
    return Library(path, code, end_id)


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: each text's ids and the end id, as id_code() says."""
    code = id_code(path, end_id)

    def run(batches):
        words = library(path, code, end_id)
        for b in slices(batches, most=2 << 20):
            yield pa.RecordBatch.from_arrays([b.column("id"), words.ids(b.column("text"))], ["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


def ranked(tokens: DataFrame, code: str) -> np.ndarray:
    """Token ids by falling frequency. Its size is bounded by the vocabulary, whatever the corpus."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in slices(batches, ("ids",)):
            seen = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), code))
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])

    found = tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values(["n", "token"], ascending=[False, True])["token"].to_numpy(np.uint32)


def write(tokens: DataFrame, path: str, code: str) -> None:
    """tokens (id, ids) as token files under path: blocks in ascending id order, and the rank table."""
    spark = tokens.sparkSession
    by_rank = ranked(tokens, code)
    spark.createDataFrame([(len(by_rank), bytearray(by_rank.astype("<u4").tobytes()))], "n int, tokens binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)
    kind, width = tokens.schema["id"].dataType.simpleString(), np.dtype(code).itemsize

    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs, parts, held = [], [], 0

        def closed():
            ids = np.frombuffer(b"".join(parts), code)
            counts = np.array([len(p) // width for p in parts], "<u4")
            payload = MAGIC + np.array([len(docs), len(ids)], "<u4").tobytes() + pack(np.concatenate([counts, sent.value[ids]]))
            columns = [[shard], [block], [before], [len(ids)], [docs], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(of), pa.binary()))], ["shard", "block", "before", "n_ids", "docs", "payload"]), len(ids)

        for b in slices(batches, ("ids",)):
            of = b.schema.field("id").type
            for doc, ids in zip(b.column("id").to_pylist(), b.column("ids").to_pylist()):
                docs.append(doc)
                parts.append(ids)
                held += len(ids) // width
                if held >= BLOCK_IDS:
                    out, n = closed()
                    yield out
                    docs, parts, held, block, before = [], [], 0, block + 1, before + n
        if docs:
            yield closed()[0]

    ordered = tokens.repartitionByRange("id").sortWithinPartitions("id", F.crc32("ids"), F.length("ids"))
    ordered.mapInArrow(run, f"shard int, block long, before long, n_ids long, docs array<{kind}>, payload binary").write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files under path: id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/ranks").first()["tokens"], "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    # One number for each shard, of which there are as many as tasks that wrote.
    per_shard = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for shard in sorted(per_shard):
        base[shard] = total
        total += per_shard[shard]
    sent = spark.sparkContext.broadcast((by_rank, base))

    def run(batches):
        tokens, first = sent.value
        for b in slices(batches, ("payload",)):
            for row in b.to_pylist():
                raw = row["payload"]
                if raw[:4] != MAGIC:
                    raise ValueError("not a token block")
                n_docs, n_ids = np.frombuffer(raw, "<u4", 2, 4).tolist()
                values = unpack(raw[12:], n_docs + n_ids)
                counts = values[:n_docs].astype(np.int64)
                data = tokens[values[n_docs:]].tobytes()
                end = np.cumsum(counts)
                start = end - counts
                pieces = [data[4 * s : 4 * e] for s, e in zip(start.tolist(), end.tolist())]
                at = start + (row["before"] + first[row["shard"]])
                columns = [pa.array(row["docs"], b.schema.field("docs").type.value_type), pa.array(at), pa.array(counts), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.select("shard", "before", "docs", "payload").mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs, writes them to path (by default a folder in the shared one) and returns what read() finds there."""
    path = path or new_path(docs.sparkSession, "tokens")
    tokens = stored(tokenized(docs, tokenizer, end_id, id_col, text_col), "ids")
    write(tokens, path, id_code(tokenizer, end_id))
    discard(tokens)
    return read(docs.sparkSession, path).withColumnRenamed("id", id_col)
