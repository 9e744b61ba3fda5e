"""Late rows and revisions of a stream, merged into a store that is read point in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources.store import merged


class StoreSink:
    """Takes batches of (keys, date, ..., available_at) rows and merges them into a store under `path`, for foreachBatch.

    A batch writes new versions of the months that it touches, under its own number, and reads only versions with smaller
    numbers; so a batch that is run again after a failure overwrites its own files and changes nothing else. A row whose key
    is known takes the value only; its first metadata survives, `available_at` with it, so that a revision doesn't move a
    value's time. Each row is also routed: `late` if it had been knowable for longer than `delay` before the newest row of
    earlier batches, else `revision` if its key is known, else `new`. The months of one batch are listed on the driver.
    """

    def __init__(self, path: str, keys: Sequence[str], update: Sequence[str] = ("value",), delay: str = "10 days") -> None:
        self.path, self.keys, self.update, self.delay = path, list(keys), list(update), delay

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        meta = [c for c in batch.columns if c not in (*self.keys, *self.update)]
        # Rows of one key within a batch follow each other as they became available.
        one = batch.groupBy(*self.keys).agg(F.min_by(F.struct(*meta), "available_at").alias("meta"), F.max_by(F.struct(*self.update), "available_at").alias("now"), F.max("available_at").alias("newest"), F.count("*").alias("n"))
        rows = one.select(*self.keys, *(F.col(f"meta.{c}").alias(c) for c in meta), *(F.col(f"now.{c}").alias(c) for c in self.update), "newest", "n").select(*batch.columns, "newest", "n", F.trunc("date", "MM").alias("month"))
        months = [r.month for r in rows.select("month").distinct().collect()]
        old = self.read(spark, number - 1)
        if old is None:
            old = rows.select(*batch.columns, "month").limit(0)
        old = old.where(F.col("month").isin(months)).select(*batch.columns, "month")
        known = rows.join(old.select(*self.keys, F.lit(True).alias("known")), self.keys, "left")
        marks = self.routes(spark, number - 1)
        mark = marks.agg(F.max("newest").alias("mark")) if marks is not None else spark.range(1).select(F.lit(None).cast("timestamp").alias("mark"))
        late = F.col("newest") < F.col("mark") - F.expr(f"interval {self.delay}")
        route = F.when(late, "late").when(F.col("known") | (F.col("n") > 1), "revision").otherwise("new")
        known.crossJoin(F.broadcast(mark)).withColumn("route", route).drop("mark", "known", "n", "month").write.mode("overwrite").parquet(f"{self.path}/routed/batch={number}")  # one row of marks
        both = merged(old, rows.select(*batch.columns, "month"), self.keys, self.update)
        both.write.mode("overwrite").partitionBy("month").parquet(f"{self.path}/store/version={number}")

    def _table(self, spark: SparkSession, name: str) -> DataFrame | None:
        home = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return spark.read.parquet(f"{self.path}/{name}") if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home) else None

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """The store after batch `upto` (all batches without a number): of each month its newest version; None if empty."""
        whole = self._table(spark, "store")
        if whole is None:
            return None
        seen = whole if upto is None else whole.where(F.col("version") <= upto)
        newest = seen.select("month", "version").distinct().groupBy("month").agg(F.max("version").alias("version"))
        return seen.join(F.broadcast(newest), ["month", "version"]).drop("version")  # a row for each month

    def routes(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """What came in with each batch up to `upto`, with its route."""
        whole = self._table(spark, "routed")
        return whole if whole is None or upto is None else whole.where(F.col("batch") <= upto)
