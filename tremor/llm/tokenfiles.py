"""Documents as token ids in Simple-8b files: written in ascending id order, read back block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b as S
from .shared import parallelism, slices, written
from .tokens import SLICE, encoder

BROADCAST_FILES = 2_000_000  # files up to which the ids before each one are broadcast (12 bytes a file); more are joined by a shuffle
FILES = "shard int, doc_id long, first long, n_tokens long, words binary, block_word binary"


def write_token_files(docs: DataFrame, to: str, path: str, end_id: int | None = 1) -> None:
    """Encodes docs (doc_id, text) by the tokenizer at `path`, ends each with `end_id`, writes files under `to`.

    File p holds the p-th range of ids in ascending order. A row is one document: `words` are its Simple-8b words and
    `block_word` the first word of each block of 128 ids (unsigned 32-bit, one more at the end), all little-endian;
    `first` counts the ids before it in its file. Empty texts hold only the end id; equal ids are ordered by text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, shard, before = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, _, _ in slices(batch, limit=SLICE):
                part = batch.slice(first, last - first)
                ids, n = mine.batch(part.column("text"), end_id)
                words, block_word, run_block = S.encode(ids, n)
                w, b = [], []
                for x, y in zip(run_block[:-1], run_block[1:], strict=True):
                    w.append(words[block_word[x] : block_word[y]].astype("<u8").tobytes())
                    b.append((block_word[x : y + 1] - block_word[x]).astype("<u4").tobytes())
                first = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard), pa.int32()), part.column("doc_id"), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(w, pa.binary()), pa.array(b, pa.binary())], ["shard", "doc_id", "first", "n_tokens", "words", "block_word"])

    dealt = docs.repartitionByRange(parallelism(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, FILES).write.option("compression", "none").parquet(to)


def read_token_files(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the files under `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                n = part.column("n_tokens").to_numpy()
                words = [np.frombuffer(x, "<u8") for x in part.column("words").to_pylist()]
                starts = [np.frombuffer(x, "<u4").astype(np.int64) for x in part.column("block_word").to_pylist()]
                before = np.cumsum([0, *map(len, words)])
                block_word = np.concatenate([*(s[:-1] + b for s, b in zip(starts, before, strict=False)), before[-1:]])
                size = np.concatenate([np.minimum(m - np.arange(0, m, S.BLOCK), S.BLOCK) for m in n])
                ids = S.decode(np.concatenate(words), block_word, size).astype("<u4")
                at = np.r_[0, np.cumsum(n)]
                out = [ids[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("shard", "doc_id", "first", "n_tokens")] + [pa.array(out, pa.binary())], ["shard", "doc_id", "first", "n_tokens", "ids"])

    files = spark.read.schema(FILES).parquet(at)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = written(totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "before")
    small = before.count() <= BROADCAST_FILES
    read = files.mapInArrow(run, "shard int, doc_id long, first long, n_tokens long, ids binary")
    return read.join(F.broadcast(before) if small else before, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")


