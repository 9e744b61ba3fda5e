"""Queries of windowed shocks, episodes and detection quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators import detect, timealign, transforms
from tremor.operators import windows as W

from . import base as B
from .base import Query, R, rounded, sql
from .series import JUMPED, SAMPLES, jumped, samples

QUERIES: dict[str, Query] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


PAST = "(partition by series_id order by date rows between {} preceding and 1 preceding)"


@query(sql("idx", "select series_id, date, " + ", ".join(f"round(lag(value, {k}) over (partition by series_id order by date), 4) as value_l{k}" for k in (1, 2, 3)) + " from idx"))
def w01_lags(spark, sf):
    return rounded(W.lags(B.index(spark, sf), ["value"], 3).drop("value"), "value_l1", "value_l2", "value_l3")


@query(sql("idx", f"select series_id, date, case when count(value) over p >= 20 then round(avg(value) over p, 4) end as mean, case when count(value) over p >= 20 then round(stddev_samp(value) over p, 4) end as sd from idx window p as {PAST.format(60)}"))
def w02_rolling_moments(spark, sf):
    x = F.col("value")
    return B.index(spark, sf).select("series_id", "date", R(W.over_past(F.avg, x, 60, 20)).alias("mean"), R(W.over_past(F.stddev_samp, x, 60, 20)).alias("sd"))


@query(sql("idx", f"select series_id, date, case when count(value) over p >= 20 then round(quantile_cont(value, 0.9) over p, 4) end as q from idx window p as {PAST.format(60)}"))
def w03_rolling_quantile(spark, sf):
    return B.index(spark, sf).select("series_id", "date", R(W.over_past(W.quantile(0.9), F.col("value"), 60, 20)).alias("q"))


@query(sql("idx", "select series_id, date, round(z, 4) as z, round(jump, 4) as jump from j", j=JUMPED.format(src="idx")))
def w04_jump(spark, sf):
    return rounded(jumped(spark, sf).select("series_id", "date", "z", "jump"), "z", "jump")


EXPANDING = "(partition by series_id order by date rows between unbounded preceding and 1 preceding)"
AR1 = f"select *, case when count(l) over p >= 59 then regr_intercept(value, l) over p + regr_slope(value, l) over p * l end as persistent from (select series_id, date, ln(1 + value) as value, lag(ln(1 + value)) over (partition by series_id order by date) as l from idx) window p as {EXPANDING}"


@query(sql("idx", "select series_id, date, round(persistent, 4) as persistent from a", a=AR1))
def w05_persistent(spark, sf):
    level = B.index(spark, sf).withColumn("value", F.log1p("value"))
    return rounded(W.persistent(level, 1).select("series_id", "date", "persistent"), "persistent")


@query(sql("idx", "select series_id, date, round(value - persistent, 4) as innovation from a", a=AR1))
def w06_innovation(spark, sf):
    level = B.index(spark, sf).withColumn("value", F.log1p("value"))
    return rounded(W.innovation(level, 1).select("series_id", "date", "innovation"), "innovation")


@query(
    sql(
        "idx",
        "select 'innovation' as method, series_id, date, round(value - persistent, 4) + 0.0 as value from a union all select 'log1p', series_id, date, round(ln(1 + value), 4) + 0.0 from idx union all select 'zscore', series_id, date, round((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 4) + 0.0 from idx window w as (partition by series_id)",
        a=AR1,
    )
)
def b08_shock_transform(spark, sf):
    each = [W.shock_transform(B.index(spark, sf), m).withColumn("method", F.lit(m)) for m in ("innovation", "log1p", "zscore")]
    out = rounded(each[0].unionByName(each[1]).unionByName(each[2]), "value")
    return out.select("method", "series_id", "date", (F.col("value") + F.lit(0.0)).alias("value"))  # no negative zero


def acts_and_threats(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").groupBy(B.day("o_orderdate")).agg(
        (F.sum(F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).otherwise(0).cast("decimal(18,2)")).cast("double") / 1000).alias("acts"),
        (F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0).cast("decimal(18,2)")).cast("double") / 1000).alias("threats"),
    )
    return o.withColumn("series_id", F.lit("GLOBAL"))


@query(None)
def w07_surprise(spark, sf):
    out = W.surprise(acts_and_threats(spark, sf), k=2)
    return rounded(out.select("date", "surprise"), "surprise")


@query(
    sql(
        "idx",
        "select series_id, date, measure, round(value, 4) as value from (select series_id, date, unnest(['LEVEL', 'PERSISTENT', 'INNOV', 'JUMP', 'LEVEL_PLUS_JUMP']) as measure, unnest([value, persistent, value - persistent, jump, value + jump]) as value from a join (select series_id, date, jump from j) using (series_id, date))",
        lev="select series_id, date, ln(1 + value) as value from idx",
        a=AR1,
        j=JUMPED.format(src="lev"),
    )
)
def w08_shock_suite(spark, sf):
    return rounded(W.shock_suite(B.index(spark, sf), order=1), "value")


HITS = f"select * from (select series_id, date, value, case when count(value) over p >= 250 then quantile_cont(value, 0.975) over p end as q from idx window p as {PAST.format(250)}) where value > q"


@query(sql("idx", "select series_id, date, round(value, 4) as value, new = 1 as first, cast(sum(new) over (partition by series_id order by date) as bigint) as episode from (select *, case when date - lag(date) over (partition by series_id order by date) > 10 or lag(date) over (partition by series_id order by date) is null then 1 else 0 end as new from h)", h=HITS))
def w09_episodes(spark, sf):
    return rounded(W.episodes(W.exceedances(B.index(spark, sf))).select("series_id", "date", "value", "first", "episode"), "value")


DETECT = """select series_id, 'LEVEL' as measure, date, ln(1 + value) as value from idx
union all select series_id, 'DIFF', date, value - lag(value) over (partition by series_id order by date) from idx"""
SCORED = ("series_id", "measure", "sample")


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, measure, date, value): each series' log level and its difference."""
    i = B.index(spark, sf)
    level = i.select("series_id", F.lit("LEVEL").alias("measure"), "date", F.log1p("value").alias("value"))
    return level.unionByName(i.select("series_id", F.lit("DIFF").alias("measure"), "date", transforms.diff(F.col("value")).alias("value")))


TAGGED = "select * from m join s on (first is null or date >= first) and (last is null or date <= last)"
SALIENT = "select t.series_id, t.measure, t.sample, round(avg(value / sd), 4) as mean_z, round(avg(case when value / sd > 2 then 1 else 0 end), 4) as hit, count(*) as n from t join (select series_id, measure, sample, stddev_samp(value) as sd from t group by 1, 2, 3) using (series_id, measure, sample) join ev on date = event_date where value is not null group by 1, 2, 3"


@query(sql("idx ev", SALIENT, m=DETECT, s=SAMPLES, t=TAGGED))
def d09_salience(spark, sf):
    tagged = transforms.tag_samples(measures(spark, sf), samples(spark))
    return rounded(detect.salience(tagged, B.events(spark, sf), SCORED), "mean_z", "hit")


@query(
    sql(
        "idx ev",
        "select series_id, sample, measure as winner, count(*) over (partition by series_id, measure) = count(*) over (partition by series_id) as stable from r where n = 1",
        m=DETECT,
        s=SAMPLES,
        t=TAGGED,
        sal=SALIENT,
        r="select series_id, sample, measure, row_number() over (partition by series_id, sample order by hit desc nulls last, mean_z desc nulls last, measure) as n from sal",
    )
)
def d10_salience_verdict(spark, sf):
    tagged = transforms.tag_samples(measures(spark, sf), samples(spark))
    return detect.verdict(rounded(detect.salience(tagged, B.events(spark, sf), SCORED), "mean_z", "hit"), within=["series_id"])


YEAR_DRAWS = 2000
MARKED = """select t.series_id, t.measure, t.sample, t.date, t.value, true as is_event from t where exists (select 1 from ev where abs(t.date - event_date) <= 3)
union all select t.series_id, t.measure, t.sample, t.date, t.value, false from t where not exists (select 1 from ev where abs(t.date - event_date) <= 10)"""


def marked(spark: SparkSession, sf: str, tag: bool = True) -> DataFrame:
    """Measures in event windows (true) and on control days (false)."""
    rows, ev = measures(spark, sf), B.events(spark, sf)
    if tag:
        rows = transforms.tag_samples(rows, samples(spark))
    near = timealign.event_window(rows, ev, 3).withColumn("is_event", F.lit(True))
    return near.unionByName(timealign.control_days(rows, ev, 10).withColumn("is_event", F.lit(False)))


AUC = """select series_id, measure, sample, case when e >= 3 and c >= 3 then round((r - e * (e + 1) / 2.0) / (e * c), 4) end as auc, e as n_event, c as n_control from
(select series_id, measure, sample, sum(case when is_event then rk else 0 end) as r, count(*) filter (where is_event) as e, count(*) filter (where not is_event) as c from
(select *, rank() over (partition by series_id, measure, sample order by value) + (count(*) over (partition by series_id, measure, sample, value) - 1) / 2.0 as rk from k where value is not null) group by 1, 2, 3)"""


@query(sql("idx ev", AUC, m=DETECT, s=SAMPLES, t=TAGGED, k=MARKED))
def d11_auc(spark, sf):
    """Also D12: by measure and sub-sample."""
    return rounded(detect.auc(marked(spark, sf), SCORED), "auc")


@query(sql("idx ev", "select *, row_number() over (partition by series_id, sample order by auc desc nulls last, measure) as rank from a", m=DETECT, s=SAMPLES, t=TAGGED, k=MARKED, a=AUC))
def w11_ranking(spark, sf):
    return detect.rank_by(rounded(detect.auc(marked(spark, sf), SCORED), "auc"), "auc", ["series_id", "sample"])


@query(
    sql(
        "idx",
        "select series_id, date, measure, round(value, 4) as value from (select series_id, date, unnest(['INNOVATION', 'JUMP', 'LEVEL_PLUS_JUMP', 'LEVEL']) as measure, unnest([value - persistent, jump, value + jump, value]) as value from a join (select series_id, date, jump from j) using (series_id, date) where persistent is not null and jump is not null)",
        lev="select series_id, date, ln(1 + value) as value from idx",
        a=AR1,
        j=JUMPED.format(src="lev"),
    )
)
def w10_detection_measures(spark, sf):
    wide = W.shock_suite(B.index(spark, sf), order=1).groupBy("series_id", "date").pivot("measure", ["INNOV", "JUMP", "LEVEL_PLUS_JUMP", "LEVEL"]).agg(F.first("value"))
    wide = wide.dropna().withColumnRenamed("INNOV", "INNOVATION")
    return rounded(wide.unpivot(["series_id", "date"], ["INNOVATION", "JUMP", "LEVEL_PLUS_JUMP", "LEVEL"], "measure", "value"), "value")


@query(sql("idx", "select series_id, date, round(avg(case when b <= a then 1.0 else 0 end), 4) as pct_rank from (select x.series_id, x.date, x.value as a, y.value as b from idx x join idx y on y.series_id = x.series_id and y.date between x.date - 365 and x.date) group by 1, 2"))
def w12_percent_rank(spark, sf):
    return rounded(W.percent_rank_year(B.index(spark, sf)).select("series_id", "date", "pct_rank"), "pct_rank")


@query(
    sql(
        "idx ev",
        "select series_id, measure, round(quantile_cont(auc, 0.025), 4) as lo, round(quantile_cont(auc, 0.975), 4) as hi, count(auc) as n_draws from a group by 1, 2",
        m=DETECT,
        t="select *, 'full' as sample from m",
        k=MARKED,
        y="select series_id, measure, year, row_number() over (partition by series_id, measure order by year) - 1 as nth, count(*) over (partition by series_id, measure) as n from (select distinct series_id, measure, year(date) as year from k)",
        p0=f"select series_id, measure, n, nth as k, b, (1 * 7919 + b * 104729 + 12345) % 1000003 as x from y cross join range({YEAR_DRAWS}) r(b)",
        p1="select *, (x * x + x * 31 + 7) % 1000003 as x1 from p0",
        p2="select *, (x1 * 7919 + k * 104729 + 12345) % 1000003 as x2 from p1",
        p="select series_id, measure, b, ((x2 * x2 + x2 * 31 + 7) % 1000003) % n as nth, count(*) as weight from p2 group by 1, 2, 3, 4",
        v="select k.series_id, k.measure, p.b, k.value, sum(case when is_event then weight else 0 end) as e, sum(case when not is_event then weight else 0 end) as c from k join y on y.series_id = k.series_id and y.measure = k.measure and y.year = year(k.date) join p on p.series_id = y.series_id and p.measure = y.measure and p.nth = y.nth where k.value is not null group by 1, 2, 3, 4",
        u="select series_id, measure, b, e, c, coalesce(sum(c) over (partition by series_id, measure, b order by value rows between unbounded preceding and 1 preceding), 0) as below from v",
        a="select series_id, measure, b, case when sum(e) >= 3 and sum(c) >= 3 then sum(e * (below + c / 2.0)) / (sum(e) * sum(c)) end as auc from u group by 1, 2, 3",
    )
)
def c08_auc_interval(spark, sf):
    return rounded(detect.auc_interval(marked(spark, sf, tag=False), ("series_id", "measure"), draws=YEAR_DRAWS), "lo", "hi")


@query(sql("idx", "select series_id, date, state, cast(date - min(date) over (partition by series_id, run) + 1 as int) as days_in_state from (select *, sum(new) over (partition by series_id order by date) as run from (select *, case when state = lag(state) over (partition by series_id order by date) then 0 else 1 end as new from (select series_id, date, case when value > 150 then 'high' else 'calm' end as state from idx)))"))
def p09_days_in_state(spark, sf):
    """State runs of P9 and ST6's batch twin."""
    i = B.index(spark, sf).withColumn("state", F.when(F.col("value") > 150, "high").otherwise("calm"))
    return W.state_runs(i).select("series_id", "date", "state", "days_in_state")


@query(sql("idx", "select series_id, date, round(100 * value / base, 4) as value from idx join (select series_id, avg(value) as base from idx where date between date '1996-01-01' and date '1997-12-31' group by 1) using (series_id)"))
def p03_rebase(spark, sf):
    i = B.index(spark, sf)
    base = transforms.between(i, "1996-01-01", "1997-12-31").groupBy("series_id").agg(F.avg("value").alias("base"))
    return i.join(base, "series_id").select("series_id", "date", R(100 * F.try_divide("value", "base")).alias("value"))


@query(sql("mktl", "select series_id, date, round(r, 4) as r5 from (select series_id, date, case when count(v) over f = 5 then sum(v) over f end as r from (select series_id, date, ln(value) - lag(ln(value)) over (partition by series_id order by date) as v from mktl where series_id in ('price', 'qty')) window f as (partition by series_id order by date rows between current row and 4 following))"))
def p17_cumulative_return(spark, sf):
    m = B.market_long(spark, sf).where("series_id in ('price', 'qty')").withColumn("v", transforms.dlog(F.col("value")))
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(0, 4)
    return m.select("series_id", "date", R(F.when(F.count("v").over(w) == 5, F.sum("v").over(w))).alias("r5"))


SPLIT = f"select 'GLOBAL' as series_id, cast(o_orderdate as date) as date, cast(sum(case when o_orderstatus <> 'O' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) / {B.UNIT} as acts, cast(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) / {B.UNIT} as threats, cast(count(*) as double) as words from orders group by 2"


def split_index(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda c: F.sum(F.when(c, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double") / B.UNIT
    o = B.table(spark, sf, "orders").groupBy(B.day("o_orderdate")).agg(part(F.col("o_orderstatus") != "O").alias("acts"), part(F.col("o_orderstatus") == "O").alias("threats"), F.count("*").cast("double").alias("words"))
    return o.withColumn("series_id", F.lit("GLOBAL"))


@query(
    sql(
        "",
        f"""with x as ({SPLIT}),
q as (select *, count(*) over p as n, quantile_cont(acts, 0.9) over p as a9, quantile_cont(acts, 0.75) over p as a7, quantile_cont(threats, 0.75) over p as t7, quantile_cont(words, 0.75) over p as w7 from x window p as (order by date rows between 250 preceding and 1 preceding)),
s as (select date, case when n < 60 then 'S0' when acts > a9 then 'S4' when acts > a7 then 'S3' when words > w7 and threats > t7 then 'S2' when words > w7 then 'S1' else 'S0' end as state from q),
r as (select *, sum(new) over (order by date) as run from (select *, case when state = lag(state) over (order by date) then 0 else 1 end as new from s))
select date, state, cast(date - min(date) over (partition by run) + 1 as int) as days_in_state from r""",
    )
)
def p09_ladder(spark, sf):
    return W.ladder(split_index(spark, sf), "words", "threats", "acts").select("date", "state", "days_in_state")


@query(None)
def p10_full_surprise(spark, sf):
    return rounded(W.full_surprise(split_index(spark, sf), "acts", "threats", "words").select("date", "surprise"), "surprise")
