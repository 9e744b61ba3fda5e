"""Structured Streaming counterparts: the same measures on a stream, replayed to the end for batch use."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources.shared import new_place

from .stateful import bounded_state

LATE = "1 day"
AFTER = "3 days"  # more than LATE and the longest window or gap that a job over the whole table keeps open


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: its file (or folder) is picked up by name under the table's parent."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    read = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return read.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_index(events: DataFrame) -> DataFrame:
    """Count and mean of each type per day, late rows within the watermark included."""
    w = F.window("ts", "1 day")
    out = events.withWatermark("ts", LATE).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("event_type").alias("series_id"), F.col("window.start").alias("start"), "n", "mean")


def sliding_index(events: DataFrame, size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """(series_id, start, n, mean) of each type in every sliding window, for append mode: a window comes out once, when the
    watermark has passed its end, and leaves the state."""
    out = events.withWatermark("ts", LATE).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("event_type").alias("series_id"), F.col("window.start").alias("start"), "n", "mean")


def histogram(values: DataFrame, key: str, value: str, width: float, bins: int) -> DataFrame:
    """(key, counts): how many values fall into each of `bins` bins of `width` from 0 on (the last one is open). Histograms of parts
    of the values add up to that of all."""
    place = F.least(F.greatest(F.floor(F.col(value) / width), F.lit(0)), F.lit(bins - 1))
    per = values.where(F.col(value).isNotNull()).groupBy(key, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return merged_histograms(per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0))).alias("counts")), key, bins)


def merged_histograms(parts: DataFrame, key: str, bins: int) -> DataFrame:
    """The sum of each key's histograms."""
    return parts.groupBy(key).agg(F.array(*(F.sum(F.get("counts", F.lit(b))) for b in range(bins))).alias("counts"))


def percentile_since(windows: DataFrame, history: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """windows with percentile: the share (in percent) of the key's history in bins up to that of the value; NULL without one. A
    stream joins the static history."""
    place = F.least(F.greatest(F.floor(F.col(value) / width), F.lit(0)), F.size("counts") - 1).cast("int")
    upto = F.aggregate(F.slice("counts", F.lit(1), place + 1), F.lit(0).cast("long"), lambda s, n: s + n)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n)
    return windows.join(history, key, "left").withColumn("percentile", F.try_divide(100.0 * upto, total)).drop("counts")


def first_of_day(events: DataFrame) -> DataFrame:
    """The first event of each user, type and day."""
    day = F.window("ts", "1 day")
    out = events.withWatermark("ts", LATE).groupBy(day.alias("window"), "user_id", "event_type").agg(F.min("ts").alias("ts"))
    return out.select("user_id", "event_type", "ts", F.col("window.start").alias("day"))


def sessions(events: DataFrame, gap: str = "12 hours 1 microsecond") -> DataFrame:
    """Clusters of a user's events with gaps of at most 12 hours."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", LATE).groupBy(s, "user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return out.select("user_id", "start", "last", "n")


def replay(spark: SparkSession, stream: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, keys: Sequence[str]) -> DataFrame:
    """Runs an update-mode stream over all that is there and returns the newest row of each of its keys.

    A batch puts out only what it changed, under its own number, so it may be lost and run again; state leaves with the
    watermark.
    """
    at, out = new_place(spark, name), job(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    told = spark.read.parquet(f"{at}/out")
    newest = F.max_by(F.struct(*out.columns), "batch").alias("row")
    return told.groupBy(*keys).agg(newest).select("row.*")


def first_of_content(events: DataFrame) -> DataFrame:
    """The first event of each content (user, type and value) and day, whatever the order of arrival: (user_id, event_type, value,
    day, first: its time and id). A day leaves the state with the watermark; the earliest of the days is the content's first."""
    day = F.window("ts", "1 day")
    out = events.withWatermark("ts", LATE).groupBy(day.alias("window"), "user_id", "event_type", "value").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return out.select("user_id", "event_type", "value", F.col("window.start").alias("day"), "first")


def unanswered(spikes: DataFrame, moves: DataFrame, within: str = "3 days") -> DataFrame:
    """Spikes (actor, ts) that no move (actor, ts) follows in time: a stream-stream left join; the alert comes when the
    watermark has passed the bound."""
    a = spikes.withWatermark("ts", LATE).alias("a")
    b = moves.withWatermark("ts", LATE).alias("b")
    on = F.expr(f"a.actor = b.actor and b.ts > a.ts and b.ts <= a.ts + interval {within}")
    return a.join(b, on, "leftOuter").where("b.ts is null").select("a.actor", "a.ts")


def appended(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over all that is there and returns what it has put out."""
    at = new_place(spark, name)
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def appended_to_end(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame], name: str, time: str) -> DataFrame:
    """What an append-mode stream over the events table has put out once all is closed, windows that were open at the last event
    included: a mark AFTER the last event, with a time only, moves the watermark past them. `time` is the output's column by
    which the mark's own window is told and left out."""
    at, last = new_place(spark, f"{name}-mark"), F.max(F.col("ts").cast("timestamp"))
    spark.read.parquet(f"{sf_dir}/events.parquet").agg(last.alias("_last"), (last + F.expr(f"interval {AFTER}")).alias("ts")).write.parquet(at)
    mark = spark.readStream.schema("ts timestamp").parquet(at)
    with bounded_state(spark):
        told = appended(spark, job(source(spark, sf_dir).unionByName(mark, allowMissingColumns=True)), name)
    return told.join(F.broadcast(spark.read.parquet(at).select("_last")), F.col(time) <= F.col("_last")).drop("_last")
