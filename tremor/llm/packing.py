"""Best-fit packing by minimum bin slack: each bin takes the fullest combination of the lengths still on hand.

Only the histogram of lengths decides which combinations are made, so the search runs over at most `capacity` counts,
whatever the number of documents. Pieces are numbered within their length by a prefix sum of per-chunk counts, and a
piece's number says which bin it gets; no piece visits the driver, and no length is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, written
from .tokens import SLICE, encoder, ranges

CAPACITY = 1024
BROADCAST_STARTS = 2_000_000  # rows (16 bytes each) up to which the pieces before each chunk are broadcast; more are joined by a shuffle
PIECES = "chunk int, doc_id long, piece int, start long, length int, rank long, ids binary"


def pieces(docs: DataFrame, path: str, end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of docs (doc_id, text): ids plus `end_id`, cut into runs of `capacity` after a shorter first one.

    rank numbers the pieces of a length within their chunk (the input partition). ids: little-endian unsigned 32-bit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, chunk, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, last, _, _ in slices(batch, limit=SLICE):
                part = batch.slice(first, last - first)
                ids, n = mine.batch(part.column("text"), end_id)
                many = -(-n // capacity)
                doc, piece = np.repeat(np.arange(len(n)), many), ranges(np.zeros_like(many), many)
                head = n - (many - 1) * capacity  # the first piece of each document
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                by = np.argsort(length, kind="stable")
                nth = np.empty(len(length), np.int64)  # of its length in this part
                nth[by] = np.arange(len(by)) - np.searchsorted(length[by], length[by])
                rank = seen[length] + nth
                seen += np.bincount(length, minlength=capacity + 1)
                raw = ids.astype("<u4").tobytes()
                ends = 4 * np.cumsum(length)
                cut = [raw[a:b] for a, b in zip((ends - 4 * length).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(np.full(len(length), chunk), pa.int32()), part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(rank), pa.array(cut, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_id", "piece", "start", "length", "rank", "ids"])

    return docs.mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths (longest first) whose sum comes nearest to `room` from below, each at most counts[length] times.

    Subset sums as a bitset: bit s of `reach` is set when sum s can be made. Copies of a length are taken as 1, 2, 4, ...
    """
    steps: list[tuple[int, int, int]] = []  # length, copies, sums before them
    reach, every = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & every
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: list[int] = []
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * copies
            total -= length * copies
    return chosen


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bin patterns ({length: copies}, how many such bins) that use up `counts`: the longest length on hand goes first,
    the fullest combination joins it, and the same bin is made again while its lengths last."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        pattern: dict[int, int] = {longest: 1}
        for x in fullest({k: v for k, v in rest.items() if v and k <= capacity - longest}, capacity - longest):
            pattern[x] = pattern.get(x, 0) + 1
        times = min(counts[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (as `pieces` makes it, read from a written table) with sequence_id and offset.

    The driver sees one count for each length up to `capacity`. An empty table gives no rows.
    """
    spark = cut.sparkSession
    local = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries: dict[int, list[tuple[int, int, int, int, int]]] = {k: [] for k in counts}  # by length: first rank, copies, bins, first bin, offset
    used, first = dict.fromkeys(counts, 0), 0
    for pattern, times in bins(counts, capacity):
        at = 0
        for length, copies in pattern.items():
            entries[length].append((used[length], copies, times, first, at))
            used[length] += copies * times
            at += copies * length
        first += times
    plan = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in entries.items()})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(local.select("chunk", "length", before.alias("before")), "starts")
    # At most chunks * capacity rows: broadcast while they are few, so that no ids are shuffled.
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts
    ranked = cut.join(starts, ["chunk", "length"]).withColumn("nth", F.col("before") + F.col("rank")).drop("before", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            seq, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for k in np.unique(length):
                mine, rows = np.flatnonzero(length == k), plan.value[int(k)]
                e = rows[np.searchsorted(rows[:, 0], nth[mine], "right") - 1]
                there = nth[mine] - e[:, 0]
                seq[mine] = e[:, 3] + there // e[:, 1]
                offset[mine] = e[:, 4] + there % e[:, 1] * k
            keep = [batch.schema.get_field_index(c) for c in ("doc_id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids, sequence_id, offset.

    Null texts count as empty and hold only the end id; equal rows are packed as often as they come.
    """
    return pack(written(pieces(docs, path, end_id, capacity), "pieces"), capacity)
