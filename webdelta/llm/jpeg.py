"""Media columns: baseline JPEG, from markers to DC-only luminance thumbnails, in numpy.

The decoder reads any baseline JPEG of 8 bits with one interleaved scan: it parses the markers, takes the entropy-coded
data apart at restart markers, and Huffman-decodes all parts of all images in step, one symbol of each part at a time. The
thumbnail has one pixel for each 8x8 luminance block, from its DC coefficient.

A payload of bytes is stored without loss in the format's unit, the quantised coefficient: 64 bytes make a grey block, in
zigzag order, with all quantisers 1. A byte b becomes the coefficient d = (b - CENTRE) in -128 .. 127, with 0 and above
moved up by one so that no coefficient is 0. Each block is a restart interval, so a reader finds its parts at once. Blocks
fill a nearly square picture; blocks that only fill its last row are empty, and an application segment has the length.

Defined results: null text is empty, and an empty text has a payload of 64 zero bytes. Equal texts give equal media. Rows
that repeat an id each give their row; null ids pass through. A text over 4 GB does not fit a picture and raises an error.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webdelta.llm.common import slices

BLOCK = 64
#: The byte whose coefficient is 1: the middle of the small letters.
CENTRE = 108
#: Huffman code lengths of the payload's tables: symbol (run 0, size) by length. Small letters have sizes 3 and 4.
DC_CODES = {2: [4], 3: [3, 5, 7], 4: [1, 2, 6, 8], 5: [0]}
AC_CODES = {2: [0x04], 3: [0x03, 0x05, 0x07], 4: [0x01, 0x02, 0x06, 0x08], 5: [0x00, 0xF0]}
LENGTH_TAG = b"WDLEN\0"
#: Bytes of text that are encoded or decoded at once.
STEP = 1 << 20


def _canonical(codes: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), as the format deals codes out."""
    out, code = {}, 0
    for length in range(1, 17):
        for symbol in codes.get(length, []):
            out[symbol] = (code, length)
            code += 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, codes: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(codes.get(n, [])) for n in range(1, 17)) + bytes(s for n in range(1, 17) for s in codes.get(n, []))


@functools.cache
def _byte_codes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte its code word with magnitude bits, and its length: as DC and as AC."""
    tables = []
    for codes in (_canonical(DC_CODES), _canonical(AC_CODES)):
        word, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for b in range(256):
            d = (b - CENTRE + 128) % 256 - 128
            v = d if d < 0 else d + 1
            size = abs(v).bit_length()
            code, n = codes[size]
            word[b] = code << size | (v if v > 0 else v + (1 << size) - 1)
            length[b] = n + size
        tables += [word, length]
    return tuple(tables)


def _header(width: int, height: int, payload: int) -> bytes:
    return b"".join([
        b"\xff\xd8", _segment(0xE9, LENGTH_TAG + struct.pack(">Q", payload)), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height * 8, width * 8, 1, 1, 0x11, 0)), _segment(0xC4, _dht(0x00, DC_CODES) + _dht(0x10, AC_CODES)),
        _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One JPEG for each payload, whose length is a positive multiple of 64."""
    if not payloads:
        return []
    dc_word, dc_len, ac_word, ac_len = _byte_codes()
    eob, eob_len = _canonical(AC_CODES)[0]
    zero, zero_len = _canonical(DC_CODES)[0]
    own = np.array([len(p) // BLOCK for p in payloads])
    width = np.array([math.isqrt(n - 1) + 1 for n in own.tolist()])
    height = -(-own // width)
    blocks = width * height
    if blocks.max() * BLOCK >= 1 << 32 or width.max() > 8191:
        raise ValueError("payload too large for a picture")
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    number = np.arange(total) - np.repeat(first, blocks)
    filled = number < np.repeat(own, blocks)
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    word, length = np.zeros((total, BLOCK + 1), np.int64), np.zeros((total, BLOCK + 1), np.int64)
    word[filled, :BLOCK], length[filled, :BLOCK] = ac_word[data], ac_len[data]
    word[filled, 0], length[filled, 0] = dc_word[data[:, 0]], dc_len[data[:, 0]]
    word[~filled, 0], length[~filled, 0] = zero << eob_len | eob, zero_len + eob_len
    bits = length[:, :BLOCK].sum(1)
    n_bytes = (bits + 7) // 8
    # Each block ends with ones up to a whole byte.
    length[:, BLOCK] = n_bytes * 8 - bits
    word[:, BLOCK] = (1 << length[:, BLOCK]) - 1
    byte_first = np.cumsum(n_bytes) - n_bytes
    ends = np.cumsum(length, axis=1)
    at = (ends - length + byte_first[:, None] * 8).ravel()
    flat_len, byte = length.ravel(), at >> 3
    three = word.ravel() << (24 - flat_len - (at & 7))
    size = int(n_bytes.sum())
    packed = np.bincount(byte, three >> 16, size + 3) + np.bincount(byte + 1, three >> 8 & 255, size + 3) + np.bincount(byte + 2, three & 255, size + 3)
    packed = packed[:size].astype(np.uint8)
    # A zero after each 0xFF, and a marker after each block.
    full = packed == 255
    to = np.arange(size) + np.cumsum(full) - full + 2 * np.repeat(np.arange(total), n_bytes)
    stuffed = np.add.reduceat(full.astype(np.int64), byte_first)
    out_len = n_bytes + stuffed + 2
    out = np.zeros(int(out_len.sum()), np.uint8)
    out[to] = packed
    end = np.cumsum(out_len)
    out[end - 2] = 255
    last = np.zeros(total, bool)
    last[first + blocks - 1] = True
    out[end - 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    starts = (end - out_len)[first]
    stops = end[first + blocks - 1]
    raw = out.tobytes()
    return [_header(w, h, len(p)) + raw[a:b] for w, h, p, a, b in zip(width.tolist(), height.tolist(), payloads, starts.tolist(), stops.tolist())]


@dataclass
class Picture:
    """What the markers say. layout: one (component, quantiser of DC, DC table, AC table) for each block of an MCU."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)
    layout: tuple = ()
    restart: int = 0
    payload: int | None = None
    scan: tuple[int, int] = (0, 0)
    mcus: tuple[int, int] = (0, 0)


@functools.lru_cache(64)
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each next 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    codes, k = {}, 16
    for n in range(1, 17):
        codes[n] = list(table[k : k + table[n - 1]])
        k += table[n - 1]
    for s, (code, n) in _canonical(codes).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


def parse(data: bytes) -> Picture:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    p, at, quant, huff = Picture(), 2, {}, {}
    while True:
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                size = 17 + sum(body[k + 1 : k + 17])
                huff[body[k]] = body[k + 1 : k + size]
                k += size
        elif marker in (0xC0, 0xC1):
            bits, p.height, p.width, count = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("8-bit samples expected")
            p.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            (p.restart,) = struct.unpack(">H", body)
        elif marker == 0xE9 and body.startswith(LENGTH_TAG):
            (p.payload,) = struct.unpack_from(">Q", body, len(LENGTH_TAG))
        elif marker == 0xDA:
            if body[0] != len(p.components):
                raise ValueError("one interleaved scan expected")
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            one = len(p.components) == 1
            h_max, v_max = (1, 1) if one else (max(c[1] for c in p.components), max(c[2] for c in p.components))
            p.mcus = (-(-p.width // (8 * h_max)), -(-p.height // (8 * v_max)))
            p.layout = tuple((i, quant[q], huff[tables[c] >> 4], huff[0x10 | tables[c] & 15]) for i, (c, h, v, q) in enumerate(p.components) for _ in range(1 if one else h * v))
            end = data.rfind(b"\xff\xd9")
            p.scan = (at, end if end >= at else len(data))
            return p


def decode_coefficients(images: list[bytes], pictures: list[Picture]) -> list[np.ndarray]:
    """For each image its quantised coefficients, a row of 64 (zigzag order) for each block in scan order. All share one layout."""
    layout = pictures[0].layout
    per_mcu = len(layout)
    n_mcu = np.array([p.mcus[0] * p.mcus[1] for p in pictures])
    interval = np.array([p.restart or n for p, n in zip(pictures, n_mcu.tolist())])
    scans = [data[slice(*p.scan)] for data, p in zip(images, pictures)]
    # Two bytes of the end marker stand between scans, so each part starts after a marker or at 0.
    raw = np.frombuffer(b"".join(s + b"\xff\xd9" for s in scans), np.uint8)
    after = np.append(raw[1:], 0)
    marker = (raw == 255) & (after >= 0xD0) & (after <= 0xD9)
    drop = marker.copy()
    drop[1:] |= marker[:-1]
    drop[1:] |= (raw[:-1] == 255) & (raw[1:] == 0)
    kept = ~drop
    data = np.concatenate([raw[kept], np.full(8, 255, np.uint8)])
    place = np.cumsum(kept) - kept
    marks = np.flatnonzero(marker)
    starts = np.concatenate([[0], place[marks[:-1]]]) if len(marks) else np.zeros(1, np.int64)
    stops = place[marks]
    parts = -(-n_mcu // interval)
    if len(starts) != int(parts.sum()):
        raise ValueError("restart markers do not fit the picture")
    image = np.repeat(np.arange(len(images)), parts)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(parts) - parts, parts)
    first_block = np.cumsum(n_mcu * per_mcu) - n_mcu * per_mcu
    block = first_block[image] + number * interval[image] * per_mcu
    left = np.minimum(interval[image], n_mcu[image] - number * interval[image]) * per_mcu
    out = np.zeros((int((n_mcu * per_mcu).sum()), 64), np.int16)
    wide = data.astype(np.uint32)
    wide = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    kinds = [_lookup(t) for _, _, dc, ac in layout for t in (dc, ac)]
    symbol, length = np.concatenate([k[0] for k in kinds]), np.concatenate([k[1] for k in kinds])
    pos, limit = starts.astype(np.int64) * 8, stops.astype(np.int64) * 8
    k = np.zeros(len(pos), np.int64)
    step = np.zeros(len(pos), np.int64)  # the block's place in its MCU
    comp = np.array([c for c, *_ in layout])
    before = np.zeros((len(pos), int(comp.max()) + 1), np.int64)
    lane = np.arange(len(pos))
    while len(lane):
        w = wide[pos >> 3]
        look = (step * 2 + (k > 0)) << 16 | (w << (pos & 7).astype(np.uint32) >> 16)
        s, n = symbol[look], length[look].astype(np.int64)
        if not n.all():
            raise ValueError("damaged Huffman data")
        pos += n
        size, run = (s & 15).astype(np.int64), (s >> 4).astype(np.int64)
        w = wide[pos >> 3]
        bits = (w << (pos & 7).astype(np.uint32)).astype(np.int64) >> (32 - size)
        value = np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)
        pos += size
        if (pos > limit[lane]).any():
            raise ValueError("Huffman data ends early")
        is_dc = k == 0
        if is_dc.any():
            d, c = lane[is_dc], comp[step[is_dc]]
            before[d, c] += value[is_dc]
            value[is_dc] = before[d, c]
            run[is_dc] = 0
        k += run
        end = ~is_dc & (s == 0)
        put = is_dc | (size > 0)
        if (k[put] > 63).any():
            raise ValueError("run past the block's end")
        out[block[lane[put]], k[put]] = value[put]
        k += 1
        k[end] = 64
        over = k > 63
        if over.any():
            done = lane[over]
            block[done] += 1
            left[done] -= 1
            k[over] = 0
            step[over] = (step[over] + 1) % per_mcu
            go = left[lane] > 0
            lane, pos, k, step = lane[go], pos[go], k[go], step[go]
    edges = first_block.tolist() + [len(out)]
    return [out[a:b] for a, b in zip(edges[:-1], edges[1:])]


def payload_of(picture: Picture, coefficients: np.ndarray) -> bytes:
    if picture.payload is None or picture.payload > coefficients.size:
        raise ValueError("the picture has no payload")
    v = coefficients.reshape(-1)[: picture.payload]
    return (v - (v > 0) + CENTRE).astype(np.uint8).tobytes()


def thumbnail(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """A pixel for each luminance block, from DC alone."""
    columns, rows = picture.mcus
    luma = [i for i, (c, *_) in enumerate(picture.layout) if c == 0]
    dc = coefficients[:, 0].reshape(rows, columns, len(picture.layout))[:, :, luma].astype(np.int64) * picture.layout[0][1]
    pixels = np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    _, h, v, _ = picture.components[0]
    if len(picture.components) == 1:
        h = v = 1
    pixels = pixels.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    h_max, v_max = (1, 1) if len(picture.components) == 1 else (max(c[1] for c in picture.components), max(c[2] for c in picture.components))
    return pixels[: -(-picture.height * v // (8 * v_max)), : -(-picture.width * h // (8 * h_max))]


def thumbnail_hash(pixels: np.ndarray) -> int:
    """64 bits: which of 64 even parts of the thumbnail, in reading order, are lighter than its mean."""
    flat = pixels.reshape(-1).astype(np.int64)
    edge = np.arange(65) * len(flat) // 64
    total = np.concatenate([[0], np.cumsum(flat)])
    size = np.maximum(edge[1:], edge[:-1] + 1)
    part = (total[size] - total[edge[:-1]]) * len(flat) > total[-1] * (size - edge[:-1])
    return int.from_bytes(np.packbits(part).tobytes(), "big")


def decode_images(images: list[bytes]) -> list[tuple[Picture, np.ndarray]]:
    """Pictures and their coefficients; images of one layout are decoded together."""
    pictures = [parse(d) for d in images]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        groups.setdefault(p.layout, []).append(i)
    out: list = [None] * len(images)
    for at in groups.values():
        for i, c in zip(at, decode_coefficients([images[i] for i in at], [pictures[i] for i in at])):
            out[i] = (pictures[i], c)
    return out


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, media (the JPEG)."""

    def run(batches):
        for b in slices(batches, most=STEP):
            data = [(t or "").encode("utf-8") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(d) for d in data], pa.int64()), pa.array(encode_payloads([padded(d) for d in data]), pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, id_col: str = "doc_id", keep_payload: bool = False) -> DataFrame:
    """From the stored bytes: width, height and hash of the thumbnail, and digests of the payload (and the payload itself)."""

    def run(batches):
        for b in slices(batches, ("media",), STEP):
            stored = b.column("media").to_pylist()
            rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumb_hash", "feature", "payload")}
            for data, (picture, coefficients) in zip(stored, decode_images(stored)):
                payload = payload_of(picture, coefficients)
                pixels = thumbnail(picture, coefficients)
                mark = f"{thumbnail_hash(pixels):016x}"
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), picture.width, picture.height, mark, f"{picture.width}x{picture.height}:{mark}", payload)
                for k, v in zip(rows, values):
                    rows[k].append(v)
            columns = [pa.array(rows[k], kinds[k]) for k in names]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), *columns], ["id", "n_bytes", *names])

    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "width": pa.int32(), "height": pa.int32(), "thumb_hash": pa.string(), "feature": pa.string(), "payload": pa.binary()}
    names = [k for k in kinds if keep_payload or k != "payload"]
    sql = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    rows = media.select(media[id_col].alias("id"), "n_bytes", "media")
    return rows.mapInArrow(run, ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", "n_bytes long", *[f"{k} {sql[kinds[k]]}" for k in names]])).withColumnRenamed("id", id_col)
