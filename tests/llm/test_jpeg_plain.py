"""The JPEG codec without Spark: exact round trips, and a plain bit-by-bit decoder as the brute-force version."""

import random
import struct

import numpy as np
import pytest

from tremor.llm import jpeg


def plain_decode(file: bytes) -> list[list[int]]:
    """Reads a baseline greyscale scan one bit at a time."""
    head = jpeg.Parsed(file)

    def codes(table):
        out, code, k = {}, 0, 17
        for length in range(1, 17):
            for _ in range(table[length]):
                out[length, code] = table[k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    dc, ac = codes(head.dc), codes(head.ac)
    body, runs, at = file[head.scan :], [b""], 0
    while at < len(body):
        if body[at] == 0xFF and body[at + 1] == 0:
            runs[-1] += b"\xff"
            at += 2
        elif body[at] == 0xFF:
            if body[at + 1] == 0xD9:
                break
            runs.append(b"")
            at += 2
        else:
            runs[-1] += body[at : at + 1]
            at += 1
    blocks = []
    for run in runs:
        bits, place = "".join(f"{x:08b}" for x in run), 0
        block, k = [0] * 64, 0
        while k < 64:
            length, code = 0, 0
            table = ac if k else dc
            while (length, code) not in table:
                code, length, place = code << 1 | int(bits[place]), length + 1, place + 1
            symbol = table[length, code]
            if k and symbol == 0:
                break
            k, size = k + (symbol >> 4), symbol & 15
            v = int(bits[place : place + size] or "0", 2)
            place += size
            block[k] = v if not size or v >> (size - 1) else v - (1 << size) + 1
            k += 1
        blocks.append(block)
    return blocks


def test_round_trip_and_plain_decoder():
    draw = random.Random(4)
    sizes = [1, 1, 2, 3, 5, 9, 10, 40]
    parts = [bytes(draw.randrange(256) for _ in range(64 * n)) for n in sizes] + [bytes(64), b"\xff" * 640, bytes([0x7F, 0x80] * 32)]
    blocks = np.array([len(x) // 64 for x in parts])
    files = jpeg.encode(np.frombuffer(b"".join(parts), np.uint8), blocks)
    heads, coded, n = jpeg.coefficients(files)
    assert jpeg.payloads(coded, n) == parts
    at = 0
    for file, head, count in zip(files, heads, n, strict=True):
        assert plain_decode(file) == coded[at : at + count].tolist()
        assert file[:2] == b"\xff\xd8" and file[-2:] == b"\xff\xd9"
        thumb = jpeg.thumbnail(head, coded[at : at + count, 0])
        assert thumb.shape == (head.height // 8, head.width // 8)
        at += count


def test_foreign_tables_and_runs():
    """A file with other Huffman tables, zero runs and 16-zero skips is read as well."""
    lengths = {0x00: 2, 0x03: 3, 0xF0: 3, 0x51: 3, 0xA2: 4}
    codes = jpeg.canonical(lengths)
    bits = ""
    put = lambda s, v, n: f"{codes[s][0]:0{codes[s][1]}b}" + (f"{v:0{n}b}" if n else "")
    dc = jpeg.canonical({3: 1, 0: 2})
    bits += f"{dc[3][0]:0{dc[3][1]}b}" + "101" + put(0x51, 0, 1) + put(0xF0, 0, 0) + put(0xA2, 3, 2) + put(0x00, 0, 0)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    file = b"\xff\xd8" + part(0xFE, b"a comment") + part(0xDB, bytes([0, 16, *[3] * 63])) + part(0xC0, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0))
    file += part(0xC4, jpeg._table(0, {3: 1, 0: 2}) + jpeg._table(0x10, lengths)) + part(0xDD, b"\0\1") + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (head,), coded, n = jpeg.coefficients([file])
    want = [0] * 64
    want[0], want[6], want[33] = 5, -1, 3
    assert coded.tolist() == [want] == plain_decode(file) and n.tolist() == [1]
    assert jpeg.thumbnail(head, coded[:, 0]).tolist() == [[138]]


def test_longer_restart_intervals_are_refused():
    """A scan whose intervals hold several blocks would be cut at the wrong places: it isn't read as if it were one block."""
    (file,) = jpeg.encode(np.arange(256, dtype=np.uint8), np.array([4]))
    at = file.index(b"\xff\xdd\0\4")
    for other in (file[: at + 4] + b"\0\2" + file[at + 6 :], file[:at] + file[at + 6 :]):
        with pytest.raises(ValueError, match="restart"):
            jpeg.coefficients([other])
    assert jpeg.payloads(*jpeg.coefficients([file])[1:]) == [bytes(range(256))]
