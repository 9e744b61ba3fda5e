"""Vectorised word work on raw UTF-8: boundaries, 64-bit word hashes and n-word window hashes of many texts at once.

Words are `[^\\x20\\x09-\\x0D]+`. All functions take the concatenated bytes of some texts with their offsets.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the low k bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # a text's first byte starts a word even after another text's last word
    start = word.copy()
    start[1:] &= ~word[:-1] | begins[1:n]
    end = word
    end[:-1] &= ~word[1:] | begins[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes a step."""
    left = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    todo, at = slice(None), starts
    while len(at):
        out[todo] = mix(out[todo] ^ (eight[at] & _KEEP[np.minimum(left, 8)]))
        more = left > 8
        todo = np.flatnonzero(more) if isinstance(todo, slice) else todo[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def windows(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of every run of n consecutive words, ignoring text boundaries (see `inside`)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] + np.uint64(salt)
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    return mix(out + np.uint64(n))


def inside(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of n words lie inside one text, and how many each text has. first: as `spans` returns it."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    total = max(int(first[-1]) - n + 1, 0)
    keep = np.ones(total, bool)
    for k in range(1, n):  # the last n - 1 words of each text start no window
        at = first[1:] - k
        at = at[(at >= first[:-1]) & (at < total)]
        keep[at] = False
    return keep, counts
