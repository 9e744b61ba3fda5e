"""Baseline JPEG as a lossless byte store, with vectorised coding and decoding of many images at once.

A payload of 64 n bytes becomes n luminance blocks; byte i of a block is its i-th quantised coefficient in zigzag order, so
entropy coding keeps it exactly (samples would lose it in the transform's rounding). No byte maps to coefficient 0, which
therefore marks filling blocks that complete the last block row. The first byte of a block is its DC coefficient, hence the
DC-only thumbnail of an image shows every 64th byte of the payload.

Every block is a restart interval: the decoder finds the restart markers and reads all blocks of all images in step, one
coefficient at a time, with ordinary Huffman tables taken from the files. It reads any baseline greyscale stream whose
restart interval is one block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices, with_text

# Symbols by code length, shortest first; our own tables for text bytes. DC symbols are sizes, AC symbols run << 4 | size.
DC_CODES = {5: 1, 7: 3, 4: 3, 6: 3, 3: 5, 8: 5, 2: 6, 1: 7, 0: 8, 9: 9}
AC_CODES = {5: 1, 7: 3, 4: 3, 6: 3, 3: 5, 8: 5, 2: 6, 1: 7, 0: 8, 9: 9}
COEFFICIENT = np.arange(256) - 128  # of each byte: -128 .. -1 and 1 .. 128, never 0
COEFFICIENT[128:] += 1
SLICE = 2 << 20


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes assigned in order of length as a JPEG file implies them."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    by = sorted(lengths.items(), key=lambda x: x[1])
    return bytes([kind, *(sum(n == k for _, n in by) for k in range(1, 17)), *(s for s, _ in by)])


def header(width: int, height: int) -> bytes:
    """All marker segments before the entropy-coded data."""
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    frame = struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)
    return b"".join(
        [
            b"\xff\xd8",
            part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            part(0xDB, bytes([0, 8, *[1] * 63])),
            part(0xC0, frame),
            part(0xC4, _table(0x00, DC_CODES)),
            part(0xC4, _table(0x10, AC_CODES)),
            part(0xDD, struct.pack(">H", 1)),
            part(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def grid(blocks: int) -> tuple[int, int]:
    """Block columns and rows of a near-square image with room for `blocks` blocks."""
    across = int(np.ceil(np.sqrt(blocks)))
    return across, -(-blocks // across)


def _bytewise(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the bits of its coefficient (Huffman code, then amplitude) and their number."""
    bits, n = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for b, v in enumerate(COEFFICIENT.tolist()):
        size = abs(v).bit_length()
        code, length = codes[size]
        bits[b], n[b] = code << size | (v if v > 0 else v + (1 << size) - 1), length + size
    return bits, n


_DC, _AC = _bytewise(canonical(DC_CODES)), _bytewise(canonical(AC_CODES))
_FILL_DC, _FILL_AC = canonical(DC_CODES)[0], canonical(AC_CODES)[0]


def scans(blocks: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (stuffed, not yet with markers) of n blocks of 64 payload bytes, and each block's length."""
    n = len(blocks)
    bits, size = _AC[0][blocks], _AC[1][blocks]
    bits[:, 0], size[:, 0] = _DC[0][blocks[:, 0]], _DC[1][blocks[:, 0]]
    if filled.any():  # a filling block: DC difference 0, end of block
        bits[filled], size[filled] = 0, 0
        bits[filled, 0], size[filled, 0] = _FILL_DC
        bits[filled, 1], size[filled, 1] = _FILL_AC
    bits = (bits[:, ::2] << size[:, 1::2].astype(np.uint64)) | bits[:, 1::2]  # pairs of codes, at most 36 bits together
    size = size[:, ::2] + size[:, 1::2]
    end = np.cumsum(size, axis=1)
    total = end[:, -1]
    words = np.zeros((n, int(total.max()) // 64 + 2), np.uint64)
    rows, at = np.arange(n), end - size
    for k in range(bits.shape[1]):
        word, room = at[:, k] >> 6, 64 - (at[:, k] & 63) - size[:, k]
        right, left = np.maximum(-room, 0).astype(np.uint64), np.maximum(room, 0).astype(np.uint64)
        words[rows, word] |= (bits[:, k] >> right) << left
        over = np.flatnonzero(room < 0)
        if len(over):
            words[over, word[over] + 1] |= bits[over, k] << (64 + room[over]).astype(np.uint64)
    pad = (-total) & 7  # the last byte is filled up with ones
    last = total + pad
    shift = (64 - (last & 63)) & 63
    words[rows, (last - 1) >> 6] |= ((np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)) << shift.astype(np.uint64)
    data = words.byteswap().view(np.uint8).reshape(n, -1)
    used = np.arange(data.shape[1]) < (last >> 3)[:, None]
    flat = data[used]
    length = last >> 3
    stuffed = flat == 0xFF
    if stuffed.any():
        block = np.repeat(rows, length)
        flat = np.insert(flat, np.flatnonzero(stuffed) + 1, 0)
        length = length + np.bincount(block[stuffed], minlength=n)
    return flat, length


def encode(payload: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """Files for images whose payloads (blocks[i] times 64 bytes each) stand one after the other in `payload`."""
    shapes = [grid(int(n)) for n in blocks]
    room = np.array([w * h for w, h in shapes])
    end = np.cumsum(room)
    nth = np.arange(int(end[-1])) - np.repeat(end - room, room)
    filled = nth >= np.repeat(blocks, room)
    cells = np.zeros((len(filled), 64), np.uint8)
    cells[~filled] = payload.reshape(-1, 64)
    flat, length = scans(cells, filled)
    # Two more bytes after each block: a restart marker, or the end marker after an image's last block.
    stop = np.cumsum(length + 2)
    out = np.empty(int(stop[-1]), np.uint8)
    mark = np.zeros(len(out), bool)
    mark[stop - 1] = mark[stop - 2] = True
    out[~mark] = flat
    out[stop - 2], out[stop - 1] = 0xFF, 0xD0 + nth % 8
    out[stop[end - 1] - 1] = 0xD9
    raw, edge = out.tobytes(), np.r_[0, stop[end - 1]]
    return [header(8 * w, 8 * h) + raw[a:b] for (w, h), a, b in zip(shapes, edge[:-1], edge[1:], strict=True)]


class Parsed:
    """What the marker segments of a file say: size, tables, where the scan starts."""

    def __init__(self, file: bytes) -> None:
        if file[:2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, self.huffman, self.quant, self.restart = 2, {}, {}, 0
        while True:
            if file[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            mark, (n,) = file[at + 1], struct.unpack_from(">H", file, at + 2)
            body, at = file[at + 4 : at + 2 + n], at + 2 + n
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif mark == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = bytes(body[: 17 + n])
                    body = body[17 + n :]
            elif mark == 0xC0:
                bits, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if bits != 8 or parts != 1:
                    raise ValueError("not 8-bit greyscale")
                self.q = body[8]
            elif mark == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif mark == 0xDA:
                if self.restart != 1 and (self.height > 8 or self.width > 8):
                    raise ValueError(f"restart intervals of {self.restart} blocks, not of one")
                self.dc, self.ac, self.scan = self.huffman[body[2] >> 4], self.huffman[0x10 | body[2] & 15], at
                return
            elif mark in (0xC1, 0xC2, 0xC3, 0xC9, 0xCA):
                raise ValueError("not a baseline image")


def lookup(table: bytes) -> np.ndarray:
    """For each 16-bit prefix: symbol << 8 | code length; 0 where no code starts so."""
    counts, symbols = table[1:17], table[17:]
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[code << (16 - length) : (code + 1) << (16 - length)] = symbols[k] << 8 | length
            code, k = code + 1, k + 1
        code <<= 1
    return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def coefficients(files: list[bytes]) -> tuple[list[Parsed], np.ndarray, np.ndarray]:
    """Headers, the quantised coefficients of all blocks (zigzag order), and each file's number of blocks."""
    heads = [Parsed(x) for x in files]
    data = np.frombuffer(b"".join(x[h.scan :] for x, h in zip(files, heads, strict=True)), np.uint8)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]  # restart markers and ends of images
    gone = np.zeros(len(data), bool)
    gone[ff[after == 0] + 1] = True
    gone[marks] = gone[marks + 1] = True
    is_end = data[marks + 1] == 0xD9
    clean = np.concatenate([data[~gone], np.full(8, 0xFF, np.uint8)])
    kept = np.cumsum(~gone)
    stop = kept[marks]
    n = len(marks)
    pos = np.r_[0, stop[:-1]] * 8
    blocks = np.diff(np.r_[0, np.flatnonzero(is_end) + 1])
    four = (clean[:-3].astype(np.uint32) << 24) | (clean[1:-2].astype(np.uint32) << 16) | (clean[2:-1].astype(np.uint32) << 8) | clean[3:]

    def peek(at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return (four[at >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF

    tables = {t: _LOOKUPS.setdefault(t, lookup(t)) for h in heads for t in (h.dc, h.ac)}
    out = np.zeros((n, 64), np.int16)
    for pair in {(h.dc, h.ac) for h in heads}:
        mine = np.flatnonzero(np.repeat([(h.dc, h.ac) == pair for h in heads], blocks))
        at, k, table = pos[mine], np.zeros(len(mine), np.int64), tables[pair[0]]
        while len(mine):
            found = table[peek(at)]
            if (found == 0).any():
                raise ValueError("no such code")
            at = at + (found & 255)
            size = (found >> 8) & 15
            k = k + (found >> 12)  # zeros skipped; none for DC
            ended = (found >> 8 == 0) & (k > 0)
            value = peek(at) >> (16 - size)
            at = at + size
            value = value - np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), (1 << size) - 1, 0)
            put = ~ended
            if put.all():
                out[mine, k] = value
            else:
                out[mine[put], k[put]] = value[put]
            k = np.where(ended, 64, k + 1)
            table = tables[pair[1]]
            live = k < 64
            if not live.all():
                mine, at, k = mine[live], at[live], k[live]
    return heads, out, blocks


def payloads(coded: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """The payload of each image: its coefficients as bytes, without the filling blocks."""
    real = coded[:, 0] != 0
    data = (coded + 128 - (coded > 0)).astype(np.uint8)
    edge = np.r_[0, np.cumsum(blocks)]
    return [data[a:b][real[a:b]].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def thumbnail(head: Parsed, dc: np.ndarray) -> np.ndarray:
    """DC-only luminance: one pixel for each block, dequantised, level-shifted and clipped."""
    flat = np.clip(np.rint(dc.astype(np.int64) * head.quant[head.q][0] / 8) + 128, 0, 255).astype(np.uint8)
    return flat.reshape(-(-head.height // 8), -(-head.width // 8))


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 pixels (nearest neighbours) is brighter than the next in its row."""
    rows, cols = np.arange(8) * thumb.shape[0] // 8, np.arange(9) * thumb.shape[1] // 9
    small = thumb[rows[:, None], cols]
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs (doc_id, text) as a JPEG file of its bytes, zero-filled to 64 n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch, limit=SLICE):
                n = np.diff(offsets)
                blocks = np.maximum(-(-n // 64), 1)
                to = np.r_[0, np.cumsum(blocks * 64)]
                payload = np.zeros(int(to[-1]), np.uint8)
                payload[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], n)] = data
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(encode(payload, blocks), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary")


DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_hash long, thumb_sha256 string"


def read_media(media: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hashes and payload digests of (doc_id, n_bytes, media) files, from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch, "media", SLICE):
                raw = data.tobytes()
                files = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                heads, coded, blocks = coefficients(files)
                edge, rows = np.r_[0, np.cumsum(blocks)], []
                for k, (file, head, payload) in enumerate(zip(files, heads, payloads(coded, blocks), strict=True)):
                    thumb = thumbnail(head, coded[edge[k] : edge[k + 1], 0])
                    mark = difference_hash(thumb)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), f"{head.width}x{head.height}:{mark:016x}", head.width, head.height, mark - (1 << 64) * (mark >> 63), hashlib.sha256(thumb.tobytes()).hexdigest()))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumb_hash", "thumb_sha256"]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, end - first) for c in (0, 1)] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.mapInArrow(run, DECODED)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Media columns of every row of docs: the stored file is made and then read back (see `encode_texts`, `read_media`).

    Null and empty texts give one block of zeros. Equal texts give equal values. Other columns are ignored. feature is
    "<width>x<height>:<difference hash of the thumbnail>".
    """
    return read_media(encode_texts(with_text(docs, id_col, text_col)))
