"""Queries of the stateful streams: each replays a stream that arrives in parts, and its SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import transforms
from tremor.sources import store
from tremor.streaming import live, stateful
from tremor.streaming.revisions import StoreSink

from . import base as B
from .base import Query, rounded, sql
from .series import JUMPED
from .shocks import AR1

QUERIES: dict[str, Query] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


SEEN = "date < (select max(date) from idx) - 1"  # what the watermark, a day behind the last row, has passed


@query(
    sql(
        "idx",
        f"select series_id, date, round(persistent, 4) as persistent, round(value - persistent, 4) as innovation, round(z, 4) as z, round(jump, 4) as jump from a join (select series_id, date, z, jump from j) using (series_id, date) where {SEEN}",
        lev="select series_id, date, ln(1 + value) as value from idx",
        a=AR1,
        j=JUMPED.format(src="lev"),
    )
)
def st03_online_shocks(spark, sf):
    """Innovation and jump of each priority's log level as its days arrive."""
    level = B.index(spark, sf).withColumn("value", F.log1p("value"))
    job = stateful.OnlineShocks("series_id")
    kinds = "value double, persistent double, innovation double, z double, jump double"
    out, _ = stateful.arriving(spark, level, "date", "st03", lambda s: stateful.stateful(s, "series_id", "date", "value", job, kinds, "1 day"))
    return rounded(out.select("series_id", F.col("at").cast("date").alias("date"), "persistent", "innovation", "z", "jump"), "persistent", "innovation", "z", "jump")


SINCE, BINS = "2024-01-20", 60  # the history holds the windows that end by then; bins are 1 wide
WEEKS = """wm as (select date_trunc('milliseconds', max(ts)) - interval 1 day as wm from events),
s as (select unnest(generate_series(date_trunc('day', min(ts)) - interval 6 days, max(ts), interval 1 day)) as start from events),
w as (select event_type as series_id, start, count(*) as n, avg(value) as mean from events join s on ts >= start and ts < start + interval 7 days group by 1, 2)"""


@query(
    f"""with {WEEKS}, h as (select series_id, least(greatest(floor(mean), 0), {BINS - 1}) as bin, count(*) as m from w where start + interval 7 days <= timestamp '{SINCE}' group by 1, 2)
select series_id, start, n, round(mean * 1000 / 997, 4) as mean, round((select 100.0 * sum(case when bin <= least(greatest(floor(mean), 0), {BINS - 1}) then m else 0 end) / sum(m) from h where h.series_id = w.series_id), 4) as percentile from w, wm where start + interval 7 days <= wm"""
)
def st01_sliding_index(spark, sf):
    """The seven-day index of each type, day by day, and its percentile in the history, in append mode."""
    e = B.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    past = e.groupBy(F.window("ts", "7 days", "1 day"), F.col("event_type").alias("series_id")).agg(F.avg("value").alias("mean")).where(F.col("window.end") <= F.lit(SINCE).cast("timestamp"))
    history = live.histogram(past, "series_id", "mean", 1.0, BINS)
    out, _ = stateful.arriving(spark, e, "ts", "st01w", lambda s: live.percentile_since(live.sliding_index(s), history, "series_id", "mean", 1.0))
    return out.select("series_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round(F.col("mean") * 1000 / B.UNIT, 4).alias("mean"), F.round("percentile", 4).alias("percentile"))


LIMIT, HUSH_DAYS = 100, 2
RECENT = "(partition by user_id order by ts rows between 50 preceding and 1 preceding)"


@query(
    f"""with wm as (select date_trunc('milliseconds', max(ts)) - interval 1 day as wm from events),
e as (select user_id, ts, value, count(*) over p as n, quantile_cont(value, 0.975) over p as q97, quantile_cont(value, 0.9) over p as q90 from events, wm where ts < wm window p as {RECENT}),
f as (select *, lag(value) over (partition by user_id order by ts) as before, lead(ts) over (partition by user_id order by ts) as next from e),
a as (select user_id, ts, 'jump' as rule, value from f where n >= 10 and value > q97
union all select user_id, ts, 'p90', value from f where n >= 10 and value > q90
union all select user_id, ts, 'state', value from f where (before > {LIMIT}) <> (value > {LIMIT})
union all select user_id, ts + interval {HUSH_DAYS} days, 'silence', value from f, wm where value > {LIMIT} and (next > ts + interval {HUSH_DAYS} days or (next is null and ts + interval {HUSH_DAYS} days < wm)))
select cast(user_id as varchar) as actor, ts, rule, value from a"""
)
def st05_triggers(spark, sf):
    """Alerts of each user's events; silence comes by a timer."""
    e = B.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    job = stateful.Triggers("actor", LIMIT, HUSH_DAYS * 86_400_000_000)
    out, _ = stateful.arriving(spark, e, "ts", "st05", lambda s: stateful.stateful(s, "user_id", "ts", "value", job, "rule string, value double", "1 day"))
    return out.select("actor", F.col("at").cast("timestamp_ntz").alias("ts"), "rule", "value")


@query(sql("idx", f"select series_id, date, state, days_in_state from (select series_id, date, state, cast(date - min(date) over (partition by series_id, run) + 1 as bigint) as days_in_state from (select *, sum(new) over (partition by series_id order by date) as run from (select *, case when state = lag(state) over (partition by series_id order by date) then 0 else 1 end as new from (select series_id, date, case when value > 150 then 'high' else 'calm' end as state from idx)))) where {SEEN}"))
def st06_days_in_state(spark, sf):
    """The stream of P9's states."""
    job = stateful.StateDays("series_id", 150)
    out, _ = stateful.arriving(spark, B.index(spark, sf), "date", "st06", lambda s: stateful.stateful(s, "series_id", "date", "value", job, "state string, days_in_state long", "1 day"))
    return out.select("series_id", F.col("at").cast("date").alias("date"), "state", "days_in_state")


AS_OF = "1998-03-01 00:00:00"


def prints(spark: SparkSession, sf: str) -> DataFrame:
    """First prints and revisions of the daily index: each with the time from which it can be known and that of its arrival.
    Every seventh day is revised 40 days later; every eleventh first print arrives 60 days late."""
    i = B.index(spark, sf)
    day, n = F.col("date"), F.datediff("date", F.lit("1992-01-01"))
    first = i.select("series_id", "date", "value", F.lit("first").alias("source"), transforms.available_at("daily", day).alias("available_at"))
    first = first.withColumn("arrived_at", F.when(n % 11 == 0, F.col("available_at") + F.expr("interval 60 days")).otherwise(F.col("available_at")))
    again = i.where(n % 7 == 0).select("series_id", "date", (F.col("value") * 2).alias("value"), F.lit("revision").alias("source"), (transforms.available_at("daily", day) + F.expr("interval 40 days")).alias("available_at"))
    return first.unionByName(again.withColumn("arrived_at", F.col("available_at")))


def replayed(spark: SparkSession, sf: str) -> StoreSink:
    """The store after all prints have come in, in three parts by arrival."""
    made: list[StoreSink] = []

    def sink(at: str) -> StoreSink:
        made.append(StoreSink(at, ["series_id", "date"]))
        return made[-1]

    stateful.arriving(spark, prints(spark, sf), "arrived_at", "st08", lambda s: s.withWatermark("available_at", "10 days").drop("arrived_at"), sink=sink)
    return made[-1]


ARRIVED = """select series_id, date, value, 'first' as source, cast(date as timestamp) + interval 36 hour as available_at, cast(date as timestamp) + interval 36 hour + case when (date - date '1992-01-01') % 11 = 0 then interval 60 days else interval 0 days end as arrived_at from idx
union all select series_id, date, value * 2, 'revision', cast(date as timestamp) + interval 36 hour + interval 40 days, cast(date as timestamp) + interval 36 hour + interval 40 days from idx where (date - date '1992-01-01') % 7 = 0"""
# Rows of one key in one part follow each other as they became available; a key that is known takes the value only.
PARTED = "select p.*, cast(floor((epoch_us(arrived_at) - lo) * 3 / (hi - lo + 1)) as int) as part from p, (select epoch_us(min(arrived_at)) as lo, epoch_us(max(arrived_at)) as hi from p)"


@query(
    sql(
        "idx",
        f"select series_id, date, round(arg_max(value, part * 1000000000000 + epoch_ms(available_at) / 1000), 4) as value, arg_min(source, part * 1000000000000 + epoch_ms(available_at) / 1000) as source from q group by 1, 2 having arg_min(available_at, part * 1000000000000 + epoch_ms(available_at) / 1000) <= timestamp '{AS_OF}'",
        p=ARRIVED,
        q=PARTED,
    )
)
def st08_as_of(spark, sf):
    """The store as of a day after late prints and revisions have been merged in."""
    seen = store.as_of(replayed(spark, sf).read(spark), None, AS_OF)
    return rounded(seen.select("series_id", "date", "value", "source"), "value")


@query(
    sql(
        "idx",
        "select part, route, count(*) as n from (select part, case when newest < mark - interval 10 days then 'late' when n > 1 or part > first then 'revision' else 'new' end as route from k) group by 1, 2",
        p=ARRIVED,
        q=PARTED,
        g="select series_id, date, part, count(*) as n, max(available_at) as newest from q group by 1, 2, 3",
        m="select part, max(newest) as newest from g group by 1",
        k="select g.*, min(part) over (partition by series_id, date) as first, (select max(m.newest) from m where m.part < g.part) as mark from g",
    )
)
def st08_routes(spark, sf):
    """How many rows of each part were new, revisions, or late by their available_at."""
    return replayed(spark, sf).routes(spark).groupBy(F.col("batch").cast("int").alias("part"), "route").agg(F.count("*").alias("n"))
