"""Queries of scans, stores, transforms, temporal joins and aggregates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators import detect, timealign, transforms
from tremor.operators import windows as W
from tremor.sources import store
from tremor.sources.shared import new_place

from . import base as B
from .base import Query, R, rounded, sql

QUERIES: dict[str, Query] = {}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DL = "case when value > 0 then ln(value) end"
OVER = "over (partition by series_id order by date)"


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep




# --- scans and stores ---------------------------------------------------------------------------------------------


@query(sql("mkt", "select date, round(price, 4) as price, round(tax, 4) as tax from mkt where date is not null"))
def a01_guarded_scan(spark, sf):
    return rounded(store.scan(B.market(spark, sf), ["price", "tax"]), "price", "tax")


@query(sql("ctry", "select date, round(max(case when series_id = 'NATION_1' then value end), 4) as n_NATION_1, round(max(case when series_id = 'NATION_2' then value end), 4) as n_NATION_2 from ctry where series_id in ('NATION_1', 'NATION_2') group by date"))
def a02_prefixed_scan(spark, sf):
    c = B.countries(spark, sf).where(F.col("series_id").isin("NATION_1", "NATION_2"))
    wide = c.withColumn("series_id", F.concat(F.lit("n_"), "series_id")).groupBy("date").pivot("series_id", ["n_NATION_1", "n_NATION_2"]).agg(F.first("value"))
    return rounded(store.scan_prefixed(wide.withColumn("other", F.lit(1.0)), "n_"), "n_NATION_1", "n_NATION_2")


@query(sql("mktl", "select case series_id when 'price' then 'BRENT' else 'US10Y' end as series_id, date, round(case series_id when 'tax' then value / 10 else value end, 4) as value from mktl where series_id in ('price', 'tax') and date between date '1996-01-01' and date '1998-12-31'"))
def a03_keyed_load(spark, sf):
    out = store.load_keyed(B.market_long(spark, sf), {"price": "BRENT", "tax": "US10Y"}, "1996-01-01", "1998-12-31", {"US10Y": 0.1})
    return rounded(out, "value")


@query(sql("gidx", "select date, round(value, 4) as value from gidx"))
def a04_source_dispatch(spark, sf):
    return rounded(store.dispatch({"orders": B.global_index, "abroad": None}, "orders", spark, sf).select("date", "value"), "value")


MONTH_LAST = "select series_id, cast(date_trunc('month', date) as date) as month, arg_max(value, date) as value from mktl group by 1, 2"


@query(sql("mktl", "select month, round(max(case when series_id = 'price' then value end), 4) as price, round(max(case when series_id = 'disc' then value end), 4) as disc from m group by month", m=MONTH_LAST))
def a05_group_scan(spark, sf):
    long = timealign.monthly(B.market_long(spark, sf).where("series_id in ('price', 'disc')"))
    return rounded(long.groupBy("month").pivot("series_id", ["price", "disc"]).agg(F.first("value")), "price", "disc")


@query(sql("mktl", f"select series_id, month, round(case when series_id = 'price' then 100 * ({DL} - lag({DL}) over w) else value - lag(value) over w end, 4) as value from m where series_id in ('price', 'disc') window w as (partition by series_id order by month)", m=MONTH_LAST))
def a06_real_macro(spark, sf):
    long = timealign.monthly(B.market_long(spark, sf).where("series_id in ('price', 'disc')")).withColumnRenamed("month", "date")
    out = transforms.apply_policy(long, transforms.kinds(spark, {"price": "index", "disc": "rate"}))
    return rounded(out.select("series_id", F.col("date").alias("month"), "value"), "value")


@query(sql("gidx mkt", "select date, round(ln(1 + g.value), 4) as g, round(ln(1 + qty), 4) as qty from gidx g full join mkt using (date)"))
def a07_benchmark_outer(spark, sf):
    g = B.global_index(spark, sf).select("date", transforms.log1p(F.col("value")).alias("g"))
    q = B.market(spark, sf).select("date", transforms.log1p(F.col("qty")).alias("qty"))
    return rounded(timealign.join_frames(g, q, how="full"), "g", "qty")


@query(sql("mktl", "select month, round(value, 4) as value from m where series_id = 'qty'", m=MONTH_LAST))
def a08_freight_month_end(spark, sf):
    return rounded(timealign.monthly(B.market_long(spark, sf).where("series_id = 'qty'")).select("month", "value"), "value")


FLAGS = "select l_returnflag, cast(l_shipdate as date) as date, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / count(*) as value from lineitem group by 1, 2"
SPLICE = """select coalesce(a.date, b.date) as date, round(coalesce(a.r, b.r), 4) as value from
(select date, ln(value) - lag(ln(value)) over (order by date) as r from f where l_returnflag = 'R' and date < date '1998-01-01' and value > 0) a full join
(select date, ln(value) - lag(ln(value)) over (order by date) as r from f where l_returnflag = 'N' and value > 0) b on a.date = b.date
where coalesce(a.r, b.r) is not null"""


@query(sql("", f"with f as ({FLAGS}) {SPLICE}"))
def j06_splice(spark, sf):
    """Also A9: the spliced dollar index scan."""
    f = B.table(spark, sf, "lineitem").groupBy("l_returnflag", B.day("l_shipdate")).agg((B.money("l_extendedprice") / F.count("*")).alias("value"))
    out = timealign.splice(f.where("l_returnflag = 'R' and date < '1998-01-01'").drop("l_returnflag"), f.where("l_returnflag = 'N'").drop("l_returnflag"))
    return rounded(out.where("value is not null"), "value")


@query(sql("ev", "select event_date from ev where event_date is not null"))
def a10_event_scan(spark, sf):
    return B.events(spark, sf).select(F.to_date(F.col("event_date").cast("string")).alias("event_date")).dropna().distinct()


def _store(spark: SparkSession, sf: str) -> DataFrame:
    i = B.index(spark, sf)
    day = F.col("date")
    return i.select("series_id", "date", "value", F.lit("D").alias("freq"), F.lit("orders").alias("source"), transforms.available_at("daily", day).alias("available_at"), F.lit("v1").alias("data_version"))


SEEN = "select series_id, date, value, cast(date as timestamp) + interval 36 hour as available_at from idx"


@query(sql("idx", "select date, " + ", ".join(f"round(max(case when series_id = '{p}' then value end), 4) as \"{p}\"" for p in PRIORITIES) + " from s where available_at <= timestamp '1998-07-01 12:00:00' group by date", s=SEEN))
def a11_as_of_read(spark, sf):
    rows = store.as_of(_store(spark, sf), PRIORITIES, "1998-07-01 12:00:00", "D", "v1")
    return rounded(store.wide(rows, PRIORITIES, check=False), *PRIORITIES)


@query(sql("idx", f"select series_id, date, round({DL} - lag({DL}) {OVER}, 4) as value from s where available_at <= timestamp '1998-07-01 12:00:00'", s=SEEN))
def a12_as_of_transformed(spark, sf):
    rows = store.as_of(_store(spark, sf), PRIORITIES, "1998-07-01 12:00:00").select("series_id", "date", "value")
    return rounded(transforms.apply_policy(rows, transforms.kinds(spark, dict.fromkeys(PRIORITIES, "price"))), "value")


@query(
    sql(
        "idx",
        "select coalesce(o.series_id, n.series_id) as series_id, coalesce(o.date, n.date) as date, round(coalesce(n.value, o.value), 4) as value, case when o.series_id is not null then 'old' else 'new' end as source from o full join n on o.series_id = n.series_id and o.date = n.date",
        o="select * from idx where date < date '1998-01-01'",
        n="select series_id, date, value * 2 as value from idx where date >= date '1997-06-01'",
    )
)
def a13_merge(spark, sf):
    i = B.index(spark, sf)
    old = i.where("date < '1998-01-01'").withColumn("source", F.lit("old"))
    new = i.where("date >= '1997-06-01'").withColumns({"value": F.col("value") * 2, "source": F.lit("new")})
    return rounded(store.merged(old, new, ["series_id", "date"], update=("value",)), "value")


@query(sql("idx", "select series_id, date, count(*) as n from (select * from idx union all select * from idx where date = date '1996-03-01') group by 1, 2 having count(*) > 1"))
def a14_key_check(spark, sf):
    i = B.index(spark, sf)
    return store.repeated_keys(i.unionByName(i.where("date = '1996-03-01'")), ["series_id", "date"])


@query(sql("idx", "select series_id, date, round(value, 4) as value, 'v1_ar5-2' as version from idx"))
def a15_versioned_sink(spark, sf):
    """A15 and A18: the index saved under a version that names the model orders, and read again; a second save is refused."""
    at, tag = new_place(spark, "versions"), store.version_tag("v1", [5, 2])
    store.save_version(B.index(spark, sf), at, tag)
    try:
        store.save_version(B.index(spark, sf), at, tag)
    except AnalysisException:
        return rounded(spark.read.parquet(at).select("series_id", "date", "value", F.col("version").cast("string").alias("version")), "value")
    raise AssertionError("a version was overwritten")


@query(sql("idx", "select series_id, date, round(value, 4) as value from idx"))
def a16_csv_sink(spark, sf):
    at = new_place(spark, "csv")
    store.save_csv(B.index(spark, sf), at)
    return rounded(spark.read.option("header", True).schema("series_id string, date date, value double").csv(at), "value")


@query(sql("idx", "select count(*) as n, printf('%012x', cast(sum(cast('0x' || substr(sha256(series_id || '|' || strftime(date, '%Y-%m-%d') || '|' || cast(cast(value as decimal(38, 6)) as varchar)), 1, 12) as ubigint)) % 281474976710656 as ubigint)) as mark from idx"))
def a17_fingerprint(spark, sf):
    return store.fingerprint(B.index(spark, sf))


# --- projections --------------------------------------------------------------------------------------------------


@query(sql("idx", "select series_id, date, round(ln(1 + value), 4) as value from idx"))
def b01_log1p(spark, sf):
    return B.index(spark, sf).withColumn("value", R(transforms.log1p(F.col("value"))))


@query(sql("idx", f"select series_id, date, round({DL} - lag({DL}) {OVER}, 4) as value from idx"))
def b02_log_return(spark, sf):
    return B.index(spark, sf).withColumn("value", R(transforms.dlog(F.col("value"))))


@query(sql("idx", f"select series_id, date, round(value - lag(value) {OVER}, 4) as value from idx"))
def b03_difference(spark, sf):
    return B.index(spark, sf).withColumn("value", R(transforms.diff(F.col("value"))))


@query(sql("ctry", f"select series_id, date, round(100 * ({DL} - lag({DL}) {OVER}), 4) as value from ctry"))
def b04_growth(spark, sf):
    return B.countries(spark, sf).withColumn("value", R(transforms.growth(F.col("value"))))


@query(sql("mktl", f"select series_id, date, round(case series_id when 'price' then {DL} - lag({DL}) {OVER} when 'qty' then {DL} - lag({DL}) {OVER} when 'disc' then value else value - lag(value) {OVER} end, 4) + 0.0 as value from mktl"))
def b05_policy(spark, sf):
    kinds = transforms.kinds(spark, {"price": "price", "qty": "price", "disc": "level", "tax": "rate", "absent": "level"})
    out = transforms.apply_policy(B.market_long(spark, sf), kinds)
    return out.withColumn("value", R("value") + F.lit(0.0))  # no negative zero


@query(sql("mktl", f"select series_id, date, round(case series_id when 'qty' then {DL} - lag({DL}) {OVER} else ln(1 + value) end, 4) as value from mktl where series_id in ('qty', 'disc')"))
def b07_freight_benchmark(spark, sf):
    return rounded(transforms.apply_policy(B.market_long(spark, sf), transforms.kinds(spark, {"qty": "price", "disc": "log1p"})), "value")


@query(sql("idx", "select series_id, date, round((value - avg(value) over w) / nullif(stddev_samp(value) over w, 0), 4) as value from idx window w as (partition by series_id)"))
def b09_zscore(spark, sf):
    return B.index(spark, sf).withColumn("value", R(transforms.zscore(F.col("value"))))


@query(sql("idx", "select series_id, date, cast(date as timestamp) + interval 36 hour as daily, cast(date_trunc('month', date) + interval 1 month as timestamp) + interval 132 hour as monthly, cast(date as timestamp) + interval 23 hour as market from idx"))
def b10_available_at(spark, sf):
    d = F.col("date")
    return B.index(spark, sf).select("series_id", "date", *(transforms.available_at(k, d).alias(k) for k in ("daily", "monthly", "market")))


@query(sql("mktl", "select date, series_id, round(value, 4) as value, 'v1' as data_version, 'lineitem' as source from mktl where value is not null"))
def b11_melt(spark, sf):
    return rounded(transforms.melt(B.market(spark, sf), ["price", "qty", "disc", "tax"], data_version="v1", source="lineitem"), "value")


@query(sql("idx", "select series_id, date, round(value, 4) as value from idx where date >= date '1997-01-01' and date <= date '1997-12-31'"))
def b12_range(spark, sf):
    return rounded(transforms.between(B.index(spark, sf), "1997-01-01", "1997-12-31"), "value")


@query(sql("gidx mkt", "select date, round(g.value, 4) as g, round(price, 4) as price from gidx g full join mkt using (date) where g.value is not null and price is not null"))
def b13_complete_cases(spark, sf):
    both = B.global_index(spark, sf).select("date", F.col("value").alias("g")).join(B.market(spark, sf).select("date", "price"), "date", "full")
    return rounded(both.dropna(subset=["g", "price"]), "g", "price")


SAMPLES = "select * from (values ('full', null, null), ('early', null, date '1997-12-31'), ('late', date '1998-01-01', null)) s(sample, first, last)"


def samples(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values ('full', cast(null as date), cast(null as date)), ('early', cast(null as date), date '1997-12-31'), ('late', date '1998-01-01', cast(null as date)) as s(sample, first, last)")


@query(sql("idx", "select sample, series_id, count(*) as n, round(avg(value), 4) as mean from idx join s on (first is null or date >= first) and (last is null or date <= last) group by 1, 2", s=SAMPLES))
def b18_samples(spark, sf):
    return transforms.tag_samples(B.index(spark, sf), samples(spark)).groupBy("sample", "series_id").agg(F.count("*").alias("n"), R(F.avg("value")).alias("mean"))


@query(sql("idx", "select series_id, date, case when date < date '1997-01-01' then 'development' when date < date '1999-01-01' then 'validation' when date < date '2001-01-01' then 'pseudo_oos' else 'holdout' end as split from idx"))
def b19_splits(spark, sf):
    d = F.col("date")
    split = F.when(d < "1997-01-01", "development").when(d < "1999-01-01", "validation").when(d < "2001-01-01", "pseudo_oos").otherwise("holdout")
    return B.index(spark, sf).select("series_id", "date", split.alias("split"))


@query(sql("idx", "select o_orderstatus as series_id, cast(o_orderdate as date) as date, case o_orderstatus when 'O' then true else false end as eligible from orders group by 1, 2, 3"))
def b17_eligible(spark, sf):
    o = B.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("series_id"), B.day("o_orderdate")).agg(F.lit(1))
    kind = F.when(F.col("series_id") == "O", "INNOVATION").otherwise("ZSCORE")
    return o.select("series_id", "date", transforms.eligible(kind).alias("eligible"))


# --- temporal joins -----------------------------------------------------------------------------------------------

ROLL = "select i.series_id, p.decision_day, avg(i.value) as mean, max(i.value) as top from prev p join idx i on i.date + 1 > p.prev and i.date + 1 <= p.decision_day group by 1, 2"


@query(sql("idx days prev", "select s.series_id, d.decision_day, round(r.mean, 4) as value from (select distinct series_id from idx) s cross join days d left join r on r.series_id = s.series_id and r.decision_day = d.decision_day", r=ROLL.replace("i.date + 1", "i.date")))
def j01_roll_forward(spark, sf):
    return rounded(timealign.roll_forward(B.index(spark, sf), B.days(spark, sf)), "value")


@query(sql("idx days prev", "select s.series_id, d.decision_day, round(case when s.series_id < '3' then r.top else r.mean end, 4) as value from (select distinct series_id from idx) s cross join days d left join r on r.series_id = s.series_id and r.decision_day = d.decision_day", r=ROLL))
def j02_information_time(spark, sf):
    return rounded(timealign.roll_forward(B.index(spark, sf), B.days(spark, sf), lag=1, extremes=("1-URGENT", "2-HIGH")), "value")


JUMPED = """select series_id, date, value, z, greatest(z - q, 0) as jump from (select *, case when count(z) over p >= 62 then quantile_cont(z, 0.95) over p end as q from
(select *, case when count(value) over p >= 62 then (value - avg(value) over p) / nullif(stddev_samp(value) over p, 0) end as z from {src} window p as (partition by series_id order by date rows between 250 preceding and 1 preceding))
window p as (partition by series_id order by date rows between 250 preceding and 1 preceding))"""
# greatest() ignores NULL in DuckDB as well
JUMPED = JUMPED.replace("greatest(z - q, 0)", "case when z - q is not null then greatest(z - q, 0) end")


def jumped(spark: SparkSession, sf: str) -> DataFrame:
    return W.jump(B.index(spark, sf))


@query(
    sql(
        "idx days prev",
        "select series_id, 'LEVEL' as measure, decision_day, round(a, 4) as value from r union all select series_id, 'JUMP', decision_day, round(b, 4) from r union all select series_id, 'LEVEL_PLUS_JUMP', decision_day, round(a + b, 4) from r",
        j=JUMPED.format(src="idx"),
        r="select i.series_id, p.decision_day, avg(i.value) as a, max(i.jump) as b from prev p join j i on i.date + 1 > p.prev and i.date + 1 <= p.decision_day group by 1, 2",
    )
)
def j03_measure_set(spark, sf):
    long = jumped(spark, sf).select("series_id", "date", F.col("value").alias("LEVEL"), F.col("jump").alias("JUMP")).unpivot(["series_id", "date"], ["LEVEL", "JUMP"], "measure", "value")
    return rounded(timealign.roll_measures(long, B.days(spark, sf), 1, {"LEVEL": "mean", "JUMP": "max"}), "value")


@query(sql("ctry", "select series_id, cast(date_trunc('month', date) + interval 1 month as date) as date, round(value, 4) as value from ctry"))
def j04_next_month(spark, sf):
    return rounded(B.countries(spark, sf).withColumn("date", timealign.next_month(F.col("date"))), "value")


@query(sql("gidx mkt days", "select date, round(g.value, 4) as g, round(price, 4) as price from gidx g join mkt using (date) join (select decision_day as date from days) using (date)"))
def j05_frame_join(spark, sf):
    frames = (B.global_index(spark, sf).select("date", F.col("value").alias("g")), B.market(spark, sf).select("date", "price"), B.days(spark, sf).withColumnRenamed("decision_day", "date"))
    return rounded(timealign.join_frames(*frames), "g", "price")


@query(sql("gidx mkt", "select mkt.date, round(g.value, 4) as value from mkt left join gidx g on g.date = mkt.date"))
def j07_reindex(spark, sf):
    return rounded(B.market(spark, sf).select("date").join(B.global_index(spark, sf).select("date", "value"), "date", "left"), "value")


@query(
    sql(
        "gidx mkt days prev",
        "select d.decision_day as date, round(ln(price) - l, 4) as ret, round(g, 4) as g from r join (select *, lag(ln(price)) over (order by date) as l from mkt) m on m.date = r.decision_day join days d using (decision_day) where l is not null and g is not null",
        r="select p.decision_day, avg(ln(1 + i.value)) as g from prev p join gidx i on i.date + 1 > p.prev and i.date + 1 <= p.decision_day group by 1",
    )
)
def j08_daily_panel(spark, sf):
    g = B.global_index(spark, sf).withColumn("value", transforms.log1p(F.col("value")))
    rolled = timealign.roll_forward(g, B.days(spark, sf), lag=1).select(F.col("decision_day").alias("date"), F.col("value").alias("g"))
    ret = B.market_long(spark, sf).where("series_id = 'price'").withColumn("ret", transforms.dlog(F.col("value"))).select("date", "ret")
    return rounded(timealign.join_frames(ret, rolled).dropna(), "ret", "g")


GLOBAL_MONTH = "select cast(date_trunc('month', date) as date) as date, avg(ln(1 + value)) as g from gidx group by 1"


@query(
    sql(
        "gidx ctry mkt",
        "select c.series_id, cast(c.date + interval 1 month as date) as date, round(c.x - regr_intercept(c.x, c.g) over w - regr_slope(c.x, c.g) over w * c.g, 4) as orth, round(c.g, 4) as g, round(p.price, 4) as price from c join p on p.date = cast(c.date + interval 1 month as date) window w as (partition by c.series_id)",
        gm=GLOBAL_MONTH,
        c="select series_id, date, ln(1 + value) as x, g from ctry join gm using (date)",
        p="select cast(date_trunc('month', date) as date) as date, arg_max(price, date) as price from mkt group by 1",
    ).replace("regr_intercept(c.x, c.g) over w", "(select regr_intercept(k.x, k.g) from c k where k.series_id = c.series_id)").replace("regr_slope(c.x, c.g) over w", "(select regr_slope(k.x, k.g) from c k where k.series_id = c.series_id)").replace(" window w as (partition by c.series_id)", "")
)
def j09_monthly_panel(spark, sf):
    """All countries at once: the country index net of the global one, known a month later, beside a market price."""
    from tremor.operators import gram

    month = F.trunc("date", "MM")
    g = B.global_index(spark, sf).groupBy(month.alias("date")).agg(F.avg(transforms.log1p(F.col("value"))).alias("g"))
    c = B.countries(spark, sf).withColumn("x", transforms.log1p(F.col("value"))).join(g, "date")
    c = gram.orthogonal(c, ["series_id"], "x", ["g"], "orth").withColumn("date", timealign.next_month(F.col("date")))
    p = timealign.monthly(B.market_long(spark, sf).where("series_id = 'price'")).select(F.col("month").alias("date"), F.col("value").alias("price"))
    return rounded(c.join(p, "date").select("series_id", "date", "orth", "g", "price"), "orth", "g", "price")


@query(sql("idx ev", "select i.series_id, i.date, round(value, 4) as value, true as near from idx i where exists (select 1 from ev where abs(i.date - event_date) <= 3) union all select i.series_id, i.date, round(value, 4), false from idx i where not exists (select 1 from ev where abs(i.date - event_date) <= 10)"))
def j11_event_windows(spark, sf):
    i, e = B.index(spark, sf), B.events(spark, sf)
    out = timealign.event_window(i, e, 3).withColumn("near", F.lit(True)).unionByName(timealign.control_days(i, e, 10).withColumn("near", F.lit(False)))
    return rounded(out.select("series_id", "date", "value", "near"), "value")


@query(sql("idx ev", "select series_id, date, round(value, 4) as value from idx join ev on date = event_date"))
def j12_at_events(spark, sf):
    return rounded(B.index(spark, sf).join(B.events(spark, sf).withColumnRenamed("event_date", "date"), "date").select("series_id", "date", "value"), "value")


@query(sql("idx", "select a.date from idx a join idx b using (date) where a.series_id = '1-URGENT' and b.series_id = '5-LOW'"))
def j13_common_support(spark, sf):
    i = B.index(spark, sf)
    return i.where("series_id = '1-URGENT'").select("date").intersect(i.where("series_id = '5-LOW'").select("date"))


@query(
    sql(
        "idx days",
        "select s.series_id, cast(d.decision_day as timestamp) as decision_time, round(f.value, 4) as value, f.date as date from (select distinct series_id from idx) s cross join days d left join lateral (select arg_max(date, date) as date, arg_max(value, date) as value from idx i where i.series_id = s.series_id and cast(i.date as timestamp) + interval 36 hour <= cast(d.decision_day as timestamp)) f on true",
    )
)
def j14_last_known(spark, sf):
    i = B.index(spark, sf)
    times = B.days(spark, sf).select(F.col("decision_day").cast("timestamp").alias("decision_time")).join(i.select("series_id").distinct())
    return rounded(timealign.last_known(i.withColumn("available_at", transforms.available_at("daily", F.col("date"))), times), "value")


@query(sql("panel", "select t, horizon, round(lead_y, 4) as y_lead from (select t, h.horizon, lead(y, cast(h.horizon as int)) over (partition by h.horizon order by t) as lead_y from panel cross join (values (0), (1), (3)) h(horizon))"))
def j15_leads(spark, sf):
    return rounded(timealign.leads(B.panel(spark, sf), "y", [0, 1, 3], ("panel_id",)).select("t", "horizon", "y_lead"), "y_lead")


# --- aggregates ---------------------------------------------------------------------------------------------------


@query(
    sql(
        "mktl",
        "select s.series_id, s.month, round(case when s.series_id = 'qty' then coalesce(m.total, 0) else m.value end, 4) as value from s left join m using (series_id, month)",
        m="select series_id, cast(date_trunc('month', date) as date) as month, arg_max(value, date) as value, sum(value) as total from mktl group by 1, 2",
        s="select series_id, cast(unnest(generate_series(min(month), max(month), interval 1 month)) as date) as month from m group by 1",
    )
)
def d01_monthly(spark, sf):
    return rounded(timealign.monthly(B.market_long(spark, sf), sums=("qty",)), "value")


@query(sql("mktl", "select series_id, month, round(value, 4) as value from m", m=MONTH_LAST))
def d02_month_end(spark, sf):
    return rounded(timealign.monthly(B.market_long(spark, sf)), "value")


@query(sql("idx", "select date, " + ", ".join(f"round(max(case when series_id = '{p}' then value end), 4) as \"{p}\"" for p in PRIORITIES) + " from idx group by date"))
def d03_pivot(spark, sf):
    return rounded(store.wide(B.index(spark, sf), PRIORITIES, check=False), *PRIORITIES)


@query(sql("idx", "select series_id, cast(date_trunc('month', date) as date) as month, round(avg(value), 4) as mean from idx group by 1, 2"))
def d04_month_mean(spark, sf):
    return B.index(spark, sf).groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(R(F.avg("value")).alias("mean"))


@query(sql("gidx mkt", "select round(corr(g.value, price), 4) as level, round(corr(ln(1 + g.value), ln(1 + price)), 4) as logs from gidx g join mkt using (date)"))
def d05_correlation(spark, sf):
    both = B.global_index(spark, sf).join(B.market(spark, sf), "date")
    return both.agg(R(F.corr("value", "price")).alias("level"), R(F.corr(F.log1p("value"), F.log1p("price"))).alias("logs"))


@query(sql("idx", "select series_id, count(value) as n, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as sd, round(min(value), 4) as low, round(quantile_cont(value, 0.25), 4) as q1, round(quantile_cont(value, 0.5), 4) as q2, round(quantile_cont(value, 0.75), 4) as q3, round(max(value), 4) as high from idx group by 1"))
def d06_summary(spark, sf):
    q = lambda p: R(F.percentile("value", F.lit(p)))
    return B.index(spark, sf).groupBy("series_id").agg(F.count("value").alias("n"), R(F.avg("value")).alias("mean"), R(F.stddev_samp("value")).alias("sd"), R(F.min("value")).alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), R(F.max("value")).alias("high"))


@query(sql("idx", "select series_id, cast(least(greatest(floor(value / 100), 0), 20) as bigint) as bucket, count(*) as n from idx group by 1, 2"))
def d06_histogram(spark, sf):
    bucket = F.least(F.greatest(F.floor(F.col("value") / 100), F.lit(0)), F.lit(20)).cast("long")
    return B.index(spark, sf).groupBy("series_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(sql("idx", "select k.series_id, round(k.mark, 4) as mark, round(100.0 * avg(case when i.value < k.mark then 1 else 0 end), 4) as pct from (select series_id, date, value as mark from idx where date between date '1998-03-02' and date '1998-03-31') k join idx i using (series_id) group by 1, k.mark"))
def d07_percent_below(spark, sf):
    i = B.index(spark, sf)
    return rounded(detect.percent_below(i, i.where("date between '1998-03-02' and '1998-03-31'").select("series_id", F.col("value").alias("mark")).distinct()), "mark", "pct")


@query(sql("idx", "select series_id, round(max(case when date between date '1998-01-01' and date '1998-06-30' then value end), 4) as peak, arg_max(date, value) filter (where date between date '1998-01-01' and date '1998-06-30') as peak_date, round(avg(case when date between date '1997-01-01' and date '1997-12-31' then value end), 4) as pre_mean, round(max(case when date between date '1998-01-01' and date '1998-06-30' then value end) / avg(case when date between date '1997-01-01' and date '1997-12-31' then value end), 4) as ratio from idx group by 1"))
def d08_peak(spark, sf):
    return rounded(detect.peak_report(B.index(spark, sf), "1998-01-01", "1998-06-30", "1997-01-01", "1997-12-31"), "peak", "pre_mean", "ratio")


@query(sql("idx", "select count(distinct series_id) as series, min(date) as first, max(date) as last, count(*) as n from idx"))
def d13_ranges(spark, sf):
    return B.index(spark, sf).agg(F.count_distinct("series_id").alias("series"), F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


@query(
    r"""with t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\d{4}-\d{2}-\d{2}', ' ', 'g'), '\b[0-9a-f]{8,}\b', ' ', 'g'), '\b[A-Za-z]+\d+\b', ' ', 'g') as text from documents),
s as (select distinct doc_id, unnest(regexp_extract_all(text, '\d+(?:\.\d+)?')) as number from t),
p as (select l_quantity as value from lineitem group by 1),
h as (select distinct unnest([round(value, 4), round(value * 100, 4), round(value * 100, 0)]) as key from p)
select doc_id, number from s where number not in ('0', '1', '100') and round(cast(number as double), 4) not in (select key from h)"""
)
def d18_claim_audit(spark, sf):
    """Numbers said in documents that no quantity accounts for."""
    held = B.table(spark, sf, "lineitem").select(F.col("l_quantity").alias("value")).distinct()
    return detect.claimed_numbers(B.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), held).distinct()


# --- sorts, sets --------------------------------------------------------------------------------------------------


@query(sql("idx", "select series_id, date, row_number() over (partition by series_id order by value desc, date) as place from idx"))
def s01_sort(spark, sf):
    """Each series in order of its values, largest first, ties by date; places make the order visible."""
    i = B.index(spark, sf).withColumn("place", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("value"), "date")).cast("long"))
    return i.select("series_id", "date", "place").orderBy("series_id", "place")


@query(sql("idx", "select series_id, date, round(value, 4) as value from (select *, row_number() over (partition by series_id order by value desc, date) as n from idx) where n <= 5"))
def s02_top_k(spark, sf):
    w = Window.partitionBy("series_id").orderBy(F.desc("value"), "date")
    return rounded(B.index(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n"), "value")


@query(sql("idx", "select series_id, arg_max(date, value) as peak, arg_min(date, value) as trough from idx group by 1"))
def s03_arg_extremes(spark, sf):
    return B.index(spark, sf).groupBy("series_id").agg(F.max_by("date", "value").alias("peak"), F.min_by("date", "value").alias("trough"))


@query(sql("idx gidx", "select series_id, count(*) as n, round(sum(value), 2) as total from (select * from idx union all select * from gidx) group by 1"))
def s04_union(spark, sf):
    both = B.index(spark, sf).unionByName(B.global_index(spark, sf))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), R(F.sum("value"), 2).alias("total"))


@query(sql("gidx mkt", "select 'both' as kind, count(*) as n from (select date from gidx intersect select date from mkt) union all select 'either', count(*) from (select date from gidx union select date from mkt) union all select 'first', count(*) from (select date from gidx except select date from mkt)"))
def s05_date_sets(spark, sf):
    a, b = B.global_index(spark, sf).select("date"), B.market(spark, sf).select("date")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.union(b).distinct(), "either")).unionByName(count(a.join(b, "date", "left_anti"), "first"))


@query("select distinct cast(ts as date) as date from events")
def s06_distinct_days(spark, sf):
    return B.table(spark, sf, "events").select(B.day("ts")).distinct()
