"""Periodic runs of words by recompression.

The words of some texts become one sequence of numbers, a unique mark before, between and after the texts. Rounds of block
compression (a stretch of one symbol becomes one symbol) and pair compression (symbols are dealt to a left and a right class;
a left one with the right one behind it becomes one symbol) shorten it until little is left: a run-length grammar in which
equal stretches are cut alike but for their edges. The longest common extension of two places climbs the levels, taking at
most one block or symbol a level, until the symbols differ, and comes down again with at most one more a level.

A run with period q and at least 2q words holds two places i and i + q of the grid of multiples of q, and equal words there;
those pairs are the candidates (n log n of them for n words), and their extensions either way give the run exactly. All of it
works on many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import forget, slices

LEAST = 12  # words of the shortest run
GRID = 1 << 16  # words whose candidates are made at once in a longer text; the grid of shorter ones is kept
QUERIES = 1 << 18  # extensions asked for at once
TOP = 64  # symbols of a sequence that isn't compressed further


@dataclass
class Level:
    """A sequence, and how the next level's symbols lie on it: where each begins (one more at the end) and which one covers
    each place. `blocks`: the next level is made of blocks, else of pairs."""

    symbols: np.ndarray
    starts: np.ndarray
    over: np.ndarray
    blocks: bool


class Grammar:
    """The levels over a sequence of numbers from 0 on that ends with a number found nowhere else."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels: list[Level] = []
        fresh = int(symbols.max()) + 1 if len(symbols) else 0
        while len(symbols) > TOP and len(self.levels) < 256:
            for blocks in (True, False):
                symbols, fresh = self._compress(symbols, fresh, blocks)
        self.top = symbols

    def _compress(self, symbols: np.ndarray, fresh: int, blocks: bool) -> tuple[np.ndarray, int]:
        begins = np.ones(len(symbols), bool)
        if blocks:
            begins[1:] = symbols[1:] != symbols[:-1]
        else:
            right = (W.mix(symbols.astype(np.uint64) + np.uint64(len(self.levels) << 40)) >> np.uint64(17) & np.uint64(1)).astype(bool)
            begins[1:] = right[:-1] | ~right[1:]
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(symbols))
        out = symbols[starts]
        many = np.flatnonzero(np.diff(bounds) > 1)
        if len(many):
            second = np.diff(bounds)[many] if blocks else symbols[starts[many] + 1]
            names = pd.factorize(out[many] << 32 | second)[0]
            out[many] = names + fresh
            fresh += int(names.max()) + 1
        self.levels.append(Level(symbols, bounds.astype(np.int32), (np.cumsum(begins) - 1).astype(np.int32), blocks))
        return out, fresh

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols are equal from places a and b on (a != b)."""
        first, a, b, ask = a, a.copy(), b.copy(), np.arange(len(a))
        stopped = []  # for each level: queries whose symbols differ there, with their places
        for level in self.levels:
            same = level.symbols[a] == level.symbols[b]
            off = ~same
            stops = [(ask[off], a[off], b[off])]
            ask, a, b = ask[same], a[same], b[same]
            over_a, over_b = level.over[a], level.over[b]
            inner = (level.starts[over_a] != a) | (level.starts[over_b] != b)
            if level.blocks:
                left_a, left_b = level.starts[over_a + 1] - a, level.starts[over_b + 1] - b
                uneven = inner & (left_a != left_b)
                if uneven.any():
                    step = np.minimum(left_a, left_b)[uneven]
                    stops.append((ask[uneven], a[uneven] + step, b[uneven] + step))
                    go = ~uneven
                    ask, over_a, over_b, inner = ask[go], over_a[go], over_b[go], inner[go]
            a, b = over_a + inner, over_b + inner
            stopped.append([np.concatenate(x) for x in zip(*stops, strict=True)] if len(stops) > 1 else list(stops[0]))
            if not len(ask):
                break
        ends = [np.zeros(0, np.int64)] * 3
        if len(ask):  # reached the top
            going = np.flatnonzero(self.top[a] == self.top[b])
            while len(going):
                a[going] += 1
                b[going] += 1
                going = going[self.top[a[going]] == self.top[b[going]]]
            ends = [ask, a, b]
        for level, here in zip(reversed(self.levels[: len(stopped)]), reversed(stopped), strict=True):
            ask, a, b = ends
            if len(ask):
                size_a, size_b = level.starts[a + 1] - level.starts[a], level.starts[b + 1] - level.starts[b]
                a, b = level.starts[a], level.starts[b]
                step = np.where(level.symbols[a] == level.symbols[b], np.minimum(size_a, size_b) if level.blocks else 1, 0)
                a, b = a + step, b + step
            ends = [np.concatenate(x) for x in zip((ask, a, b), here, strict=True)]
        out = np.empty(len(first), np.int64)
        out[ends[0]] = ends[1]
        return out - first


_GRID: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pairs(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """All (j, q) with low <= j < high and q dividing j, by j."""
    q = np.arange(1, high)
    first = np.maximum(-(-low // q), 1)
    many = np.maximum((high - 1) // q - first + 1, 0)
    q, step = np.repeat(q, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    j = q * (np.repeat(first, many) + step)
    order = np.argsort(j, kind="stable")
    return j[order].astype(np.int32), q[order].astype(np.int32)


def candidates(numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, q) of one text: i and i + q are multiples of q with equal words, and 2q words fit into the text."""
    n = len(numbers)
    for low in range(0, n, GRID):
        high = min(low + GRID, n)
        if not low:
            size = min(GRID, max(1024, 1 << (high - 1).bit_length()))
            if size not in _GRID:
                _GRID[size] = _pairs(1, size)
            j, q = _GRID[size]
            end = np.searchsorted(j, high)
            j, q = j[:end], q[:end]
        else:
            j, q = _pairs(low, high)
        hit = np.flatnonzero(numbers[j] == numbers[j - q])
        j, q = j[hit], q[hit]
        fits = q <= n // 2
        yield (j - q)[fits], q[fits]


def runs(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, period) of every run, by text, start and period. numbers: the words of all texts as numbers from 0
    on; first: each text's first word, one more at the end. Starts and ends count from the text's first word."""
    texts = len(first) - 1
    marks = int(numbers.max()) + 1 if len(numbers) else 0
    shift = np.arange(texts) + 1  # a mark stands before each text
    whole = np.insert(numbers.astype(np.int64), first, marks + np.arange(texts + 1))
    found: list[np.ndarray] = []
    grammars: list[Grammar] = []

    def take(asked: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        if not grammars:
            grammars.extend((Grammar(whole), Grammar(whole[::-1].copy())))
        text = np.repeat([t for t, _, _ in asked], [len(i) for _, i, _ in asked])
        zero = first[text] + shift[text]
        i, q = (np.concatenate([x[k] for x in asked]).astype(np.int64) for k in (1, 2))
        at = zero + i
        ahead = grammars[0].extend(at, at + q)
        back = grammars[1].extend(len(whole) - at, len(whole) - at - q)
        keep = ahead + back + q >= np.maximum(LEAST, 2 * q)
        found.append(np.stack([text, i - back, i + q + ahead, q])[:, keep])

    asked, many = [], 0
    for t in range(texts):
        if first[t + 1] - first[t] < LEAST:
            continue
        for i, q in candidates(numbers[first[t] : first[t + 1]]):
            if len(i):
                asked.append((t, i, q))
                many += len(i)
            if many >= QUERIES:
                take(asked)
                asked, many = [], 0
    if asked:
        take(asked)
    text, start, end, period = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    if not len(text):
        return text, start, end, period
    order = np.lexsort((period, end, start, text))
    text, start, end, period = text[order], start[order], end[order], period[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])]  # the smallest period
    text, start, end, period = text[new], start[new], end[new], period[new]
    order = np.lexsort((period, start, text))
    return text[order], start[order], end[order], period[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at, end, data, offsets in slices(batch):
        begin, stop, first = W.spans(data, offsets)
        size, n = stop - begin, len(begin)
        byte = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if n else np.zeros(0, np.int64)
        packed = data[byte]
        bounds = np.r_[0, np.cumsum(size)]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(packed)]).dictionary_encode()
        numbers = coded.indices.to_numpy()
        text, start, over, period = runs(numbers, first)
        drop = np.zeros(n + 1, np.int64)
        np.add.at(drop, first[text] + start + period, 1)
        np.add.at(drop, first[text] + over, -1)
        keep = np.cumsum(drop[:n]) == 0
        # Kept words with a space behind each; a text is what lies between its first word and its last space.
        room = np.where(keep, size + 1, 0)
        ends = np.r_[0, np.cumsum(room)]
        out = np.full(ends[-1], 32, np.uint8)
        goes = np.repeat(keep, size)
        out[(np.repeat(ends[:-1] - bounds[:-1], size) + np.arange(len(packed)))[goes]] = packed[goes]
        cut = ends[first]
        texts = [out[a : max(a, b - 1)].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        many = np.r_[0, np.cumsum(np.bincount(text, minlength=end - at))].astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(many), pa.StructArray.from_arrays([pa.array(start), pa.array(over - start), pa.array(period)], fields=list(_RUN)))
        kept = np.r_[0, np.cumsum(keep)][first]
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(kept)), listed, pa.array(texts, pa.binary()).cast(pa.string()), batch.column(2).slice(at, end - at)], ["doc_id", "n_words", "n_removed", "runs", "text", "rest"])


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, runs (start, length, period; by start, then period), text (the words left, joined by one
    space) and rest (a struct of the columns in `keep`) for every row of docs; nothing is shuffled.

    A run is a stretch of words with smallest period q, of at least max(12, 2q) words, that no neighbouring word extends; a word
    goes if a run holds it behind the run's first q words. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts have
    no words. Every row is judged for itself, whatever its id; other columns are ignored. An empty table gives no rows.
    """
    rest = F.struct(*(F.col(c) for c in keep or [id_col])).alias("rest")
    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            yield from _collapsed(batch)

    kind = ready.schema["rest"].dataType.simpleString()
    return ready.mapInArrow(run, f"doc_id long, n_words long, n_removed long, runs array<struct<start:long,length:long,period:long>>, text string, rest {kind}")


def with_planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, a tenth of them with a repeated stretch: with h = crc32(decimal doc_id) and g = h div 10,
    where h % 10 = 0, all words from word a = g % n on repeat the first p = 1 + (n - a) div (3 + g % 8) of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    each = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("chosen"))
    each = each.withColumn("words", F.when(F.col("chosen"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    each = each.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    each = each.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("n") - F.col("a"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return each.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period; else nulls) and digests of runs and text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    read = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    return read.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
