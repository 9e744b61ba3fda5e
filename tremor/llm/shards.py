"""Shards along a Hilbert curve: metadata are quantised, rows ordered by their place on the curve, and the order is cut.

Neighbours on the curve are neighbours in every dimension, so each shard covers a small box of sizes, sources and languages
and a reader can skip files by their column statistics.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parallelism, written

BITS = 4  # of each dimension


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of integer cells (rows) with coordinates below 2 ** bits (columns).

    After Skilling, "Programming the Hilbert curve" (2004): undo the excess work from the top bit down, Gray-encode,
    then interleave the coordinates' bits.
    """
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(x[i] & q, p, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _before(df: DataFrame, order: Sequence[str], weight: str | None = None) -> DataFrame:
    """df (written first) with the sum of `weight` (default: one a row) over all rows before each in `order`, and the total.

    Rows are dealt by ranges; only one count for each partition meets in one place.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = np.ones(len(b), np.int64) if weight is None else b.column(b.schema.get_field_index(weight)).to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part), pa.int32()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64())], [*b.schema.names, "_part", "_nth", "_n"])
            before = int(ends[-1]) if len(b) else before

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    dealt = df.repartitionByRange(parallelism(df), *order).sortWithinPartitions(*order)
    ranked = written(dealt.mapInArrow(number, f"{schema}, _part int, _nth long, _n long"), "ranked")
    parts = ranked.groupBy("_part").agg(F.sum("_n").alias("n"))  # a row for each partition
    whole = Window.orderBy("_part")
    parts = parts.select("_part", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    return ranked.join(parts, "_part").withColumn("before", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_n", "_before")


BROADCAST_VALUES = 1_000_000  # distinct values of a dimension up to which their cells are broadcast; more are joined by a shuffle


def _celled(traits: DataFrame, name: str) -> DataFrame:
    """traits with `name`, a string, replaced by its cell: distinct values in their whole order, cut where rows before them
    pass each 2 ** -BITS of all rows."""
    values = _before(traits.groupBy(name).agg(F.count("*").alias("n")), [name], "n")
    cells = values.select(name, F.expr(f"cast((before * {1 << BITS}) div total as int)").alias("_cell"))
    cells = F.broadcast(cells) if values.count() <= BROADCAST_VALUES else cells
    return traits.join(cells, name).drop(name).withColumnRenamed("_cell", name)


def assign(docs: DataFrame, shards: int = 24, dims: Sequence[str] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, place, shard, slot and rest (a struct of the columns in `keep`) for every row of docs: law
    `rows`, counts at most one apart.

    size: UTF-8 bytes of the text (null: none) plus 8; it is the last dimension, after `dims` (those that docs has). Numbers
    are cut at their quantiles, strings (null: empty) by their whole value. Equal places are ordered by id, then checksum.
    Null ids come first; equal rows take a slot each; an empty table gives no rows.
    """
    dims = [c for c in dims if c in docs.columns]
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8"))
    strings = {f"dim{k}": dict(docs.dtypes)[c] == "string" for k, c in enumerate(dims)}
    values = [F.coalesce(F.col(c), F.lit("")) if strings[f"dim{k}"] else F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for k, c in enumerate(dims)]
    traits = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), *(v.alias(f"dim{k}") for k, v in enumerate(values)), F.struct(*(F.col(c) for c in keep or [id_col])).alias("rest"))
    names = [*strings, "size"]
    traits = written(traits, "traits")
    numbers = [c for c in names if not strings.get(c)]
    steps = F.array(*(F.lit(k / (1 << BITS)) for k in range(1, 1 << BITS)))
    edges = traits.select(*(F.percentile_approx(c, steps, 10_000).alias(c) for c in numbers)).first()
    cuts = [sorted(set(edges[c] or [])) if c in numbers else None for c in names]
    for c in names:
        if c not in numbers:
            traits = _celled(traits, c)

    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        cells = [x.to_numpy().astype(np.int64) if c is None else np.minimum(np.searchsorted(np.array(c), x.to_numpy(), "right"), (1 << BITS) - 1) for c, x in zip(cuts, columns, strict=True)]
        return pd.Series(hilbert(np.stack(cells, 1), BITS))

    rank = _before(traits.select("doc_id", "size", "text_crc32", place(*names).alias("place"), "rest"), ["place", "doc_id", "text_crc32"])
    rank = rank.withColumn("shard", F.expr(f"cast((before * {shards}) div total as int)"))
    first = F.expr(f"(cast(shard as long) * total + {shards - 1}) div {shards}")
    return rank.select("doc_id", "size", "text_crc32", "place", "shard", (F.col("before") - first).alias("slot"), "rest")


def write_shards(docs: DataFrame, to: str, shards: int = 24, dims: Sequence[str] = ("source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all rows and columns of docs as Parquet under `to`, one folder for each shard, rows in slot order. The folders
    are named by `shard`, with as many underscores behind it as docs' own column names need."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    placed = assign(docs, shards, dims, id_col, text_col, docs.columns).select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "rest")
    dealt = placed.repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_slot")
    dealt.select("rest.*", F.col("_shard").alias(name)).write.partitionBy(name).parquet(to)
