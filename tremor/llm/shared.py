"""What the training-data operators share: reading tables, cutting lineage in the shared folder, Arrow text slices."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one step of a vectorised operator holds at a time inside a task (one longer text is one step).
SLICE_BYTES = 4 << 20
BATCH_BYTES = 8 << 20

_LEARNT: dict[Hashable, Any] = {}


def learnt(key: Hashable, make: Callable[[], Any]) -> Any:
    """What this Python process has learnt under `key` in earlier tasks, begun by `make`. A process keeps one such thing: a
    task of another operator lets go of it, so that workers which Spark uses again don't pile up memory."""
    if key not in _LEARNT:
        _LEARNT.clear()
        _LEARNT[key] = make()
    return _LEARNT[key]


def forget() -> None:
    """Lets go of what this Python process has learnt and hands freed memory back: for tasks that hold much of their own, at
    their start and, as an idle worker keeps what it has, at their end."""
    _LEARNT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES rather than of 10,000 rows, whatever their length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, read by Spark's own reader so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or under the warehouse where that is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: lineage ends there, and lost executors lose nothing."""
    spark, at = df.sparkSession, new_place(df.sparkSession, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def parallelism(df: DataFrame) -> int:
    """A partition count that follows the input: what Spark's shuffles use, at least one per input split."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def with_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null becomes empty), whatever other columns a table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of one Arrow batch of at most `limit` text bytes (or one row): first row, end row, bytes, offsets."""
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    if not len(col):
        return
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(col):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
