"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A merge list has a sufficient lookahead: how many symbols past a position can still change the token that ends there. A
merge of u and v waits on what may take v, or a right part of v, away first: an earlier merge whose left side is v or a
right part of it, and what that one waits on in turn. So ahead(u, v) = |v| + the largest ahead of such earlier merges, one
pass over the list in order, and the lookahead is the largest of all. The encoder keeps a window of symbols, emits tokens
that end at least that far before the window's end, and goes on from the last boundary; BPE of a rest that starts at a
token boundary is the rest of the tokens. Memory is a constant of the merge list, however long the word.

Decoding feeds each token's bytes to a byte-to-text state machine that holds an unfinished character between feeds.

Words between white space are encoded once and kept in a table of bounded size; long words are always streamed. A text
is read in blocks of words, and each block is encoded, hashed, decoded and dropped before the next.

Defined results: null text is encoded as empty: no tokens, empty decoded text. Repeated rows each give their row; null ids
pass through. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from webdelta.llm.common import lean, slices

#: Words and pre-tokens in a generation of a worker's tables (about 200 bytes each, two generations), and the longest that is kept.
KEPT_WORDS, KEPT_PARTS, KEPT_CHARS = 150_000, 150_000, 64
#: Characters of a text that are cut into words at a time, and what cuts words.
BLOCK, SPACE = 1 << 16, re.compile(r"[\t-\r ]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A tokenizer file: byte-level BPE with an end-of-word suffix, NFC, lower case, pre-tokens by one pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError(f"{path}: not the kind of tokenizer that this operator knows")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ", 1)) for x in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {}
        for i, p in enumerate(pairs):
            self.rank.setdefault(p, i)
        self.symbols = byte_symbols()
        self.lookahead = self._lookahead(pairs)
        self.pieces = {i: t for t, i in (self.ids | self.special).items()}

    def _length(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) and token != self.suffix else 0)

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        right: dict[str, str] = {}
        reach: dict[str, int] = {}
        most = 1
        for u, v in pairs:
            ahead, part = 0, v
            while part is not None:
                ahead = max(ahead, reach.get(part, 0))
                part = right.get(part)
            ahead += self._length(v)
            most = max(most, ahead)
            reach[u] = max(reach.get(u, 0), ahead)
            right.setdefault(u + v, v)
        return most

    def merged(self, symbols: list[str]) -> list[str]:
        """Tokens of a whole window: the earliest merge of the list first, the leftmost of equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = self.rank
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != p[0] or parts[j] != p[1]:
                continue
            parts[i], parts[j] = p[0] + p[1], None
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (q := (parts[i], parts[k])) in rank:
                    heapq.heappush(heap, (rank[q], i, q))
            h = before[i]
            if h >= 0 and (q := (parts[h], parts[i])) in rank:
                heapq.heappush(heap, (rank[q], h, q))
        return [p for p in parts if p is not None]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one pre-token, from its bytes, each emitted once it is stable."""
        window: list[str] = []
        full = 2 * self.lookahead + 64
        last = None
        for b in data:
            if last is not None:
                window.append(last)
            last = self.symbols[b]
            if len(window) >= full:
                done = 0
                for token in self.merged(window):
                    if done + len(token) > len(window) - self.lookahead:
                        break
                    done += len(token)
                    yield self.ids[token]
                del window[:done]
        if last is not None:
            window.append(last + self.suffix)
            for token in self.merged(window):
                yield self.ids[token]

    def pretokens(self, word: str) -> Iterator[str | int]:
        """Pre-tokens of text without ASCII white space, and the ids of special tokens in it."""
        for k, part in enumerate(self.split_special.split(word) if self.split_special and "<" in word else [word]):
            if k % 2:
                yield self.special[part]
            elif part:
                # Lower case is by character: capital sigma never becomes final sigma.
                low = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if low.isalpha() and low.isascii():
                    yield low
                else:
                    yield from self.pattern.findall(low)

    def encode(self, pretoken: str) -> list[int]:
        data = pretoken.encode("utf-8")
        if len(data) > 24:
            return list(self.stream(data))
        parts = [self.symbols[b] for b in data]
        parts[-1] += self.suffix
        rank, none = self.rank, len(self.rank)
        while len(parts) > 1:
            ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
            if (best := min(ranks)) == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]


class Kept(dict):
    """What make(word) gave, for words seen lately: when one table is full it becomes the old one, and what is still in use moves over."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.old.clear()
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Words(Kept):
    """Word to its little-endian ids of the given width, by way of its pre-tokens."""

    def __init__(self, pretokens, encode, code: str = "<u4"):
        super().__init__(self._word, KEPT_WORDS)
        self.pretokens, self.width = pretokens, np.dtype(code).itemsize
        self.parts = Kept(lambda p: np.array(encode(p), code).tobytes(), KEPT_PARTS)

    def _word(self, word: str) -> bytes:
        return b"".join([p.to_bytes(self.width, "little") if isinstance(p, int) else self.parts[p] for p in self.pretokens(word)])

    def blocks(self, text: str | None) -> Iterator[bytes]:
        """Ids of a whole text, block by block. Words are cut at ASCII white space, across which neither normal form nor
        pre-tokens reach; a block has about BLOCK characters and ends with a word, so only its words and ids are held."""
        at, end = 0, len(text or "")
        while at < end:
            stop = end
            if end - at > BLOCK:
                cut = SPACE.search(text, at + BLOCK)
                stop = cut.start() if cut else end
            part = text[at:stop]
            for c in "\t\n\x0b\x0c\r":
                if c in part:
                    part = part.replace(c, " ")
            yield b"".join(map(self.__getitem__, filter(None, part.split(" "))))
            at = stop


class Decoder:
    """Ids to text. Without a decoder in the tokenizer file, tokens are joined by one space, special tokens included."""

    def __init__(self, vocabulary: Vocabulary):
        pieces = [b" " + vocabulary.pieces.get(i, "").encode("utf-8") for i in range(max(vocabulary.pieces) + 1)]
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def text(self, blocks: Iterable[bytes], step: int = 1 << 18) -> Iterator[str]:
        """The text of blocks of little-endian ids, in pieces; the state machine keeps the bytes of a character that a piece cuts."""
        machine, skip = codecs.getincrementaldecoder("utf-8")("replace"), 1
        for block in blocks:
            ids = np.frombuffer(block, "<u4")
            for a in range(0, len(ids), step):
                part = ids[a : a + step]
                n = self.length[part]
                ends = np.cumsum(n)
                at = np.repeat(self.start[part] - (ends - n), n) + np.arange(int(ends[-1]))
                # The first token of a text has no space before it.
                yield machine.decode(self.flat[at].tobytes()[skip:])
                skip = 0
        yield machine.decode(b"", True)


@functools.lru_cache(2)
def loaded(path: str) -> tuple[Vocabulary, Words, Decoder]:
    v = Vocabulary(path)
    return v, Words(v.pretokens, v.encode), Decoder(v)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids (little-endian unsigned 32-bit integers)."""

    @lean
    def run(batches):
        _, words, _ = loaded(path)
        for b in slices(batches):
            ids = [b"".join(words.blocks(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of encode(): id, text."""

    @lean
    def run(batches):
        decoder = loaded(path)[2]
        for b in slices(batches, ("ids",)):
            texts = ["".join(decoder.text([x or b""])) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(encoded[id_col].alias("id"), "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass: id, n_tokens, and SHA-256 of the ids and of the decoded text, piece by piece."""

    @lean
    def run(batches):
        _, words, decoder = loaded(path)
        for b in slices(batches):
            n, of_ids, of_text = [], [], []
            for t in b.column("text").to_pylist():
                count, sha_ids, sha = 0, hashlib.sha256(), hashlib.sha256()

                def seen():
                    nonlocal count
                    for block in words.blocks(t):
                        count += len(block) // 4
                        sha_ids.update(block)
                        yield block

                for piece in decoder.text(seen()):
                    sha.update(piece.encode("utf-8"))
                n.append(count)
                of_ids.append(sha_ids.hexdigest())
                of_text.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
