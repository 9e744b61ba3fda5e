"""Simple-8b: each 64-bit word holds a 4-bit selector and as many equally wide integers as fit in the other 60 bits.

Blocks of up to BLOCK integers start at a word of their own, so blocks are coded and read independently; a block's last
word is filled up with zeros. Selector 0 is the escape: the next word is one raw 64-bit integer.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
# (integers, bits) of selectors 1 to 15; the format's fixed values. Selector 0 is the escape.
PACKED = [(120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([1] + [n for n, _ in PACKED])


_SMALL = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    """How many bits each integer takes."""
    if len(v) and v.max() < 1 << 16:
        return _SMALL[v.astype(np.uint16)]
    low = np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    high = v >> np.uint64(32)
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low).astype(np.uint8) if high.any() else low


# Each window length as two shorter ones, the second beginning `shift` entries later.
_JOIN = {2: (1, 1, 1), 3: (2, 1, 2), 4: (2, 2, 2), 5: (4, 1, 4), 6: (4, 2, 4), 7: (4, 3, 4), 8: (4, 4, 4), 10: (8, 2, 8), 12: (8, 4, 8), 15: (8, 7, 8), 20: (12, 8, 12), 30: (15, 15, 15), 60: (30, 30, 30), 120: (60, 60, 60)}


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each entry of the blocks the selector of the fullest word that can begin there, 0 for the escape.

    bits: blocks as rows, followed by zeros. A word that fits leaves room for every shorter one, so the selector follows from
    how many of them fit.
    """
    width = bits.shape[1]
    widest, fits = {1: bits}, np.zeros(bits.shape, np.uint8)
    for n, wide in reversed(PACKED):
        if n > 1:
            a, b, shift = _JOIN[n]
            widest[n] = widest[a].copy()
            np.maximum(widest[n][:, : width - shift], widest[b][:, shift:], out=widest[n][:, : width - shift])
        fits += widest[n] <= wide
    return np.where(fits > 0, 16 - fits, 0).astype(np.uint8)


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes runs of integers (their lengths sum to len(values)).

    Returns the words, for each block the index of its first word (one more at the end), and for each run the index of
    its first block (one more at the end).
    """
    values, lengths = values.astype(np.uint64), lengths.astype(np.int64)
    blocks = -(-lengths // BLOCK)
    run_block = np.r_[0, np.cumsum(blocks)]
    n = int(run_block[-1])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), run_block
    run = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(n) - run_block[run]
    size = np.minimum(lengths[run] - nth * BLOCK, BLOCK)
    at = np.arange(BLOCK)
    filled = at < size[:, None]
    grid = np.zeros((n, BLOCK + max(COUNT)), np.uint64)
    grid[:, :BLOCK][filled] = values  # runs and their blocks stand in order
    bits = np.zeros(grid.shape, np.uint8)
    bits[:, :BLOCK][filled] = _bits(values)
    best = _selectors(bits)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    live, pos = np.arange(n), np.zeros(n, np.int64)
    while len(live):
        sel = best[live, pos]
        word = sel.astype(np.uint64) << np.uint64(60)
        raw = np.zeros(0, np.int64)
        for k in np.unique(sel):
            mine = np.flatnonzero(sel == k)
            if not k:
                raw = mine
                continue
            count, wide = PACKED[k - 1]
            if wide:
                one = grid[live[mine, None], pos[mine, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(wide))
                word[mine] |= np.bitwise_or.reduce(one, axis=1)
        out.append((live, word))
        if len(raw):
            out.append((live[raw], grid[live[raw], pos[raw]]))
        pos = pos + COUNT[sel]
        more = pos < size[live]
        live, pos = live[more], pos[more]
    block = np.concatenate([b for b, _ in out])
    order = np.argsort(block, kind="stable")
    return np.concatenate([w for _, w in out])[order], np.r_[0, np.cumsum(np.bincount(block, minlength=n))], run_block


def decode(words: np.ndarray, block_word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The integers of all blocks in order. block_word: each block's first word (one more at the end); size: integers in each."""
    words = words.astype(np.uint64)
    n = np.diff(block_word)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)  # not the raw half of an escape
    if (sel == 0).any():
        for i in np.flatnonzero(sel == 0):  # in order, so that a raw word with four leading zeros isn't taken for a selector
            if head[i]:
                head[i + 1] = False
    block = np.repeat(np.arange(len(n)), n)
    count = np.where(head, COUNT[sel], 0)
    before = np.cumsum(count) - count
    place = before - np.repeat(before[block_word[:-1][n > 0]], n[n > 0])  # within its block
    base = np.r_[0, np.cumsum(size)]
    out = np.zeros(int(base[-1]), np.uint64)
    for k in np.unique(sel[head]):
        mine = np.flatnonzero(head & (sel == k))
        if not k:
            out[base[block[mine]] + place[mine]] = words[mine + 1]
            continue
        many, wide = PACKED[k - 1]
        if not wide:
            continue
        at = place[mine, None] + np.arange(many)
        real = at < size[block[mine], None]
        got = (words[mine, None] >> (np.arange(many, dtype=np.uint64) * np.uint64(wide))) & np.uint64((1 << wide) - 1)
        out[(base[block[mine], None] + at)[real]] = got[real]
    return out
