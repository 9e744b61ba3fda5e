"""Joins by the time at which values become known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .transforms import dlog_dense


def decision_map(days: DataFrame) -> DataFrame:
    """(date, decision_day): each calendar day with the next decision day, days before the first one's window excepted.

    days (decision_day) is a calendar: at most one row a day, so its map is small whatever the series.
    """
    w = Window.orderBy("decision_day")
    weekday = F.weekday("decision_day")  # Monday is 0
    business = F.date_sub("decision_day", F.when(weekday == 0, 3).when(weekday == 6, 2).otherwise(1))
    prev = F.coalesce(F.lag("decision_day").over(w), business)
    return days.distinct().withColumn("prev", prev).select("decision_day", F.explode(F.sequence(F.date_add("prev", 1), F.col("decision_day"))).alias("date"))


def roll_forward(long: DataFrame, days: DataFrame, lag: int = 0, reducer: Column | None = None, extremes: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, decision_day, value): values known since the last decision day, by mean, or max for series in `extremes`.

    lag: days until a value is known. Windows without a value give NULL. An equi join on calendar days, no range join.
    """
    known = long.withColumn("date", F.date_add("date", lag))
    mapped = known.join(F.broadcast(decision_map(days)), "date")
    value = reducer if reducer is not None else F.when(F.first("series_id").isin(*extremes), F.max("value")).otherwise(F.avg("value")) if extremes else F.avg("value")
    rolled = mapped.groupBy("series_id", "decision_day").agg(value.alias("value"))
    grid = days.select("decision_day").distinct().join(long.select("series_id").distinct())
    return grid.join(rolled, ["series_id", "decision_day"], "left")


def roll_measures(long: DataFrame, days: DataFrame, lag: int, reducers: dict[str, str]) -> DataFrame:
    """(series_id, measure, decision_day, value): each measure by its own reducer ('mean' or 'max'); the composite
    LEVEL_PLUS_JUMP is rebuilt from its parts afterwards. A measure without reducer, or a missing part, is an error."""
    if bad := [m for m, r in reducers.items() if r not in ("mean", "max")]:
        raise ValueError(f"no reducer for {bad}")
    known = long.withColumn("date", F.date_add("date", lag)).join(F.broadcast(decision_map(days)), "date")
    tails = [m for m, r in reducers.items() if r == "max"]
    value = F.when(F.col("measure").isin(*tails), F.max("value")).otherwise(F.avg("value"))
    parts = known.where(F.col("measure").isin(*reducers)).groupBy("series_id", "measure", "decision_day").agg(value.alias("value"))
    if not {"LEVEL", "JUMP"} <= set(reducers):
        raise ValueError("LEVEL and JUMP are needed for the composite")
    both = parts.where("measure in ('LEVEL', 'JUMP')").groupBy("series_id", "decision_day").pivot("measure", ["LEVEL", "JUMP"]).agg(F.first("value"))
    whole = both.select("series_id", F.lit("LEVEL_PLUS_JUMP").alias("measure"), "decision_day", (F.col("LEVEL") + F.col("JUMP")).alias("value"))
    return parts.unionByName(whole)


def next_month(date: Column) -> Column:
    """The bucket in which a month's value is known: the month after."""
    return F.add_months(F.trunc(date, "MM"), 1)


def join_frames(*frames: DataFrame, on: str = "date", how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), frames)


def splice(first: DataFrame, second: DataFrame) -> DataFrame:
    """(date, value): log returns of two series (date, value); the first one has priority where both have one."""
    a, b = (dlog_dense(x.withColumn("series_id", F.lit(0))).select("date", F.col("value").alias(c)) for x, c in ((first, "a"), (second, "b")))
    return a.join(b, "date", "full").select("date", F.coalesce("a", "b").alias("value"))


def event_window(df: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Rows of df within `width` calendar days of an event (event_date)."""
    return df.join(_around(events, width), "date", "left_semi")


def control_days(df: DataFrame, events: DataFrame, buffer: int) -> DataFrame:
    """Rows of df more than `buffer` calendar days from every event."""
    return df.join(_around(events, buffer), "date", "left_anti")


def _around(events: DataFrame, days: int) -> DataFrame:
    return events.select(F.explode(F.sequence(F.date_sub("event_date", days), F.date_add("event_date", days))).alias("date")).distinct()


def last_known(facts: DataFrame, times: DataFrame) -> DataFrame:
    """As-of join: for each (series_id, decision_time) the value and date of the newest fact available by then.

    Union and one window over time, not a range join; facts (series_id, available_at, date, value).
    """
    f = facts.select("series_id", F.col("available_at").alias("at"), F.lit(0).alias("asks"), F.struct("value", "date").alias("fact"))
    t = times.select("series_id", F.col("decision_time").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast(f.schema["fact"].dataType).alias("fact"))
    w = Window.partitionBy("series_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = f.unionByName(t).withColumn("fact", F.last("fact", ignorenulls=True).over(w)).where("asks = 1")
    return seen.select("series_id", F.col("at").alias("decision_time"), F.col("fact.value").alias("value"), F.col("fact.date").alias("date"))


def leads(df: DataFrame, y: str, horizons, by: tuple[str, ...] = ("series_id",), order: str = "t") -> DataFrame:
    """df once for each horizon h, with y_lead = y at t + h rows: all horizons in one pass."""
    w = Window.partitionBy(*by).orderBy(order)
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead(y, h).over(w).alias("y_lead")) for h in horizons))
    return df.withColumn("_l", each).withColumn("_l", F.explode("_l")).select("*", "_l.horizon", "_l.y_lead").drop("_l")


def month_spine(df: DataFrame) -> DataFrame:
    """(series_id, month): every month from a series' first to its last."""
    ends = df.groupBy("series_id").agg(F.trunc(F.min("date"), "MM").alias("a"), F.trunc(F.max("date"), "MM").alias("b"))
    return ends.select("series_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))


def monthly(df: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """(series_id, month, value): last non-null value of a month, or the sum for series in `sums` (0 for an empty month)."""
    month = F.trunc("date", "MM").alias("month")
    by = df.groupBy("series_id", month).agg(F.sum("value").alias("s"), F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date"))).alias("l"))
    summed = F.col("series_id").isin(*sums) if sums else F.lit(False)
    return month_spine(df).join(by, ["series_id", "month"], "left").select("series_id", "month", F.when(summed, F.coalesce("s", F.lit(0.0))).otherwise(F.col("l")).alias("value"))
