"""Analogue episodes: exact nearest neighbours by angle with pruned blocks, and the paths that followed them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.sources.shared import written

PIVOTS = 256  # at most; their vectors come to the driver
ROWS = 4096  # vectors of a block's part, about
QUERIES = 1024  # queries that meet a part at once, about


def standardised(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """df (rows with all features) with `vector`: the features less their mean over their standard deviation, scaled to length 1.
    A feature without spread counts as 0; rows whose vector is 0 are left out."""
    w = Window.partitionBy(*keys) if keys else None
    rows = df.dropna(subset=list(features))
    moments = rows.groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    both = rows.join(moments, list(keys)) if w is not None else rows.crossJoin(F.broadcast(moments))  # one row
    z = F.array(*(F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(0.0)) for c in features))
    both = both.withColumn("vector", z).withColumn("_n", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)))
    return both.where("_n > 0").select(*df.columns, F.transform("vector", lambda v: v / F.col("_n")).alias("vector"))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _vectors(batch: pa.RecordBatch, column: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(column))
    return col.flatten().to_numpy().reshape(len(col), -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int, apart: int = 0, past: bool = False) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest of rows (id, at, vector of length 1) for every query of the same columns, by
    cosine, ties by id; only rows with |at - query's at| > `apart` (and, with `past`, at < query's at) count, before the cut.

    Rows lie in blocks around pivots. A query first searches its own block; what it finds there bounds the angle of its k-th
    neighbour, and of the other blocks only those are searched whose pivot's angle less the block's radius is within that
    bound, so none is missed. A block is dealt out in parts of about ROWS rows and QUERIES queries.
    """
    n = rows.count()
    empty = rows.sparkSession.createDataFrame([], "query_id long, id long, cosine double, rank int")
    if not n:
        return empty
    count = int(min(PIVOTS, max(1, np.sqrt(n) / 4)))
    found = rows.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").toArrow()
    pivots = np.array(found.column("vector").to_pylist(), float)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(_vectors(batch, "vector"), pivots)
            home = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(angle[np.arange(len(home)), home])], [*batch.schema.names, "block", "angle"])

    kinds = "id long, at long, vector array<double>"
    placed = written(rows.select(F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "vector").mapInArrow(homes, f"{kinds}, block int, angle double"), "placed")
    sizes = {r.block: (r.n, r.radius) for r in placed.groupBy("block").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # one row a pivot
    radius = np.array([sizes.get(b, (0, -np.inf))[1] for b in range(len(pivots))])
    parts = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(b, (0, 0))[0] // ROWS))) for b in range(len(pivots)))), F.col("block") + 1)
    asked = queries.select(F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at"), "vector")
    chunks = max(1, -(-asked.count() // QUERIES))
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks)).cast("int")
    held = placed.select("block", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "id", "at", "vector")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            score = np.stack(right["vector"].to_numpy()) @ np.stack(left["vector"].to_numpy()).T
            ids, at = left["id"].to_numpy(), left["at"].to_numpy()
            for q, t, row in zip(right["id"], right["at"], score, strict=True):
                ok = np.flatnonzero((ids != q) & (np.abs(at - t) > apart) & ((at < t) if past else True))
                top = ok[np.lexsort((ids[ok], -row[ok]))[:k]]
                out.append(pd.DataFrame({"query_id": q, "id": ids[top], "cosine": row[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "cosine": []})

    def met(wanted: DataFrame) -> DataFrame:
        each = wanted.select("block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), chunk.alias("chunk"), "id", "at", "vector")
        return held.groupBy("block", "part", "chunk").cogroup(each.groupBy("block", "part", "chunk")).applyInPandas(search, "query_id long, id long, cosine double")

    own = written(asked.mapInArrow(homes, f"{kinds}, block int, angle double"), "asked")
    first = written(met(own), "first")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    bound = first.withColumn("n", F.row_number().over(w)).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))).alias("bound"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle, home = _angles(_vectors(batch, "vector"), pivots), batch.column(3).to_numpy()
            limit = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            near = angle - radius[None, :] <= np.where(np.isnan(limit), np.inf, limit)[:, None] + 1e-7
            near[np.arange(len(home)), home] = False
            near &= np.isfinite(radius)[None, :]
            q, b = np.nonzero(near)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(q)) for c in range(3)), pa.array(b, pa.int32())], ["id", "at", "vector", "block"])

    more = own.join(bound, "id", "left").select("id", "at", "vector", "block", "bound").mapInArrow(others, f"{kinds}, block int")
    every = first.unionByName(met(more))
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def paths(found: DataFrame, outcomes: DataFrame, least: int = 5) -> DataFrame:
    """(query_id, horizon, n, median, low, high, same_sign, verdict) from neighbours (query_id, id) and outcomes (id, horizon,
    value): the spread of what followed the analogues.

    verdict: `silent` below `least` analogues with an outcome, and then there are no figures; `dispersed` where the quartiles
    have different signs; else `clear`. same_sign is the share of outcomes with the median's sign.
    """
    joined = found.select("query_id", "id").join(outcomes.where("value is not null"), "id")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    each = joined.groupBy("query_id", "horizon").agg(F.count("*").alias("n"), q.alias("q"), F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0)).alias("up"), F.avg(F.when(F.col("value") < 0, 1.0).otherwise(0.0)).alias("down"))
    low, mid, high = (F.get("q", F.lit(i)) for i in range(3))
    told = F.col("n") >= least
    same = F.when(mid > 0, F.col("up")).when(mid < 0, F.col("down")).otherwise(1 - F.col("up") - F.col("down"))
    verdict = F.when(~told, "silent").when(low * high < 0, "dispersed").otherwise("clear")
    return each.select("query_id", "horizon", "n", F.when(told, mid).alias("median"), F.when(told, low).alias("low"), F.when(told, high).alias("high"), F.when(told, same).alias("same_sign"), verdict.alias("verdict"))
