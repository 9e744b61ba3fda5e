"""Queries of text-based indices, signals, their evaluation, and the streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators import analogues, clusters, indices, transforms, windows
from tremor.sources.shared import written
from tremor.streaming import live

from . import base as B
from .base import Query, R, rounded, sql

QUERIES: dict[str, Query] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d, l = B.table(spark, sf, "documents"), B.table(spark, sf, "labels")
    return d.select("doc_id", "lang", "source", "text").join(l.select("doc_id", F.col("toxic").alias("score")), "doc_id")


@query("select lang, source, round(100.0 * sum(toxic) / count(*), 4) as index, count(*) as n from documents join labels using (doc_id) group by grouping sets ((lang), (lang, source), ())")
def p01_news_share(spark, sf):
    return rounded(indices.news_share(articles(spark, sf), [["lang"], ["lang", "source"], []]).select("lang", "source", "index", "n"), "index")


WEIGHTS = "select event_type as actor_group, round(1.0 / count(*), 12) * 1000 as weight from events group by 1"


@query(f"with w as ({WEIGHTS}) select cast(ts as date) as date, round(sum(weight * value / 100) / sum(weight), 4) as index from events join w on event_type = actor_group group by 1")
def p02_weighted_index(spark, sf):
    e = B.table(spark, sf, "events").select(B.day("ts"), F.col("event_type").alias("actor_group"), (F.col("value") / 100).alias("score"))
    weights = e.groupBy("actor_group").agg((F.round(1.0 / F.count("*"), 12) * 1000).alias("weight"))
    return rounded(indices.weighted_index(e, weights, ["date"]), "index")


@query("select lang, round(avg(m), 4) as index, round(count(*) * 1.0 / (select count(distinct source) from documents join labels using (doc_id)), 4) as coverage, count(*) * 1.0 / (select count(distinct source) from documents join labels using (doc_id)) >= 0.5 as complete from (select lang, source, avg(toxic) as m from documents join labels using (doc_id) group by 1, 2) group by 1")
def p04_source_balanced(spark, sf):
    return rounded(indices.source_balanced(articles(spark, sf), ["lang"]), "index", "coverage")


@query(
    r"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
a as (select doc_id, w, list_filter(range(1, len(w) + 1), lambda i: list_contains(['the', 'license', 'work'], w[i])) as places from t)
select doc_id, len(w) as n_words, len(places) > 0 and not list_contains(w, 'public') as hit, case when len(w) > 0 then round(100.0 * len(list_filter(range(1, len(places)), lambda i: places[i + 1] - places[i] <= 10)) / len(w), 4) end as score from a"""
)
def p05_keyword_filter(spark, sf):
    out = indices.keyword_filter(B.table(spark, sf, "documents").select("doc_id", "text"), ["the", "license", "work"], ["public"])
    return rounded(out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "hit", "score"), "score")


_PRINT = " + ".join(f"case when 2 * sum((p >> {k}) & 1) > count(*) then cast({1 << k} as ubigint) else cast(0 as ubigint) end" for k in range(64))
CLUSTERS = {
    "tok": r"select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents",
    "hw": "select doc_id, list_transform(w, lambda x: md5_number_lower(x)) as h from tok where len(w) > 0",
    "pr": "select distinct doc_id, unnest(case when len(h) = 1 then h else list_transform(range(1, len(h)), lambda i: cast((cast(h[i] as uhugeint) * 31 + h[i + 1]) % 18446744073709551616 as ubigint)) end) as p from hw",
    "fp": f"select doc_id, {_PRINT} as f from pr group by doc_id",
    "ds": "select distinct f from fp",
    "ln": f"select a.f as a, b.f as b from ds a, ds b where bit_count(xor(a.f, b.f)) <= {clusters.DISTANCE}",
    "re": "select a, b from ln union select re.a, ln.b from re join ln on ln.a = re.b",
    "rt": "select a as f, min(b) as root from re group by a",
    "cl": "select doc_id, min(doc_id) over (partition by root) as cluster_id, count(*) over (partition by root) as cluster_size from fp join rt using (f) union all select doc_id, doc_id, 1 from tok where len(w) = 0",
}


def _clusters_sql(body: str) -> str:
    return "with recursive " + ", ".join(f"{k} as ({v})" for k, v in CLUSTERS.items()) + " " + body


@query(_clusters_sql("select doc_id, cluster_id, cluster_size from cl"))
def p06_event_clusters(spark, sf):
    """Clusters of near-equal articles among all documents."""
    return clusters.event_clusters(B.table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query(_clusters_sql("select lang, cast(sum(n) as bigint) as n_articles, count(*) as n_events, round(sum(total) / sum(n), 4) as attention, round(avg(severity), 4) as event_risk, round(sum(n) * 1.0 / count(*), 4) as amplification from (select lang, cluster_id, max(toxic) as severity, sum(toxic) as total, count(*) as n from documents join cl using (doc_id) join labels using (doc_id) group by 1, 2) group by 1"))
def p06_event_votes(spark, sf):
    """One vote per cluster beside the articles' mean, by language."""
    found = clusters.event_clusters(B.table(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "cluster_id")
    scored = articles(spark, sf).drop("text").join(found, "doc_id")
    return rounded(clusters.votes(scored, ["lang"]), "attention", "event_risk", "amplification")


@query("select user_id as actor, cast(ts as date) as date, round(sum(greatest(value - 50, 0)), 4) as escalation, round(sum(greatest(50 - value, 0)), 4) as conciliation, round(sum(value - 50), 4) as net, round(max(value - 50), 4) as loudest from events group by 1, 2")
def p07_signed_index(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("actor"), B.day("ts"), (F.col("value") - 50).alias("score"), F.lit(1.0).alias("weight"))
    return rounded(indices.signed_index(e, ["actor", "date"]), "escalation", "conciliation", "net", "loudest")


@query("select actor, date, cast(date - lag(date) over (partition by actor order by date) as int) as silent_days from (select distinct user_id as actor, cast(ts as date) as date from events)")
def p07_silence(spark, sf):
    return indices.silence(B.table(spark, sf, "events").select(F.col("user_id").alias("actor"), B.day("ts")).distinct())


@query(sql("", "select n_name as nation, cast(date_trunc('month', o_orderdate) as date) as month, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p, round(min(o_totalprice), 4) as low from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2"))
def p08_pair_months(spark, sf):
    o, c, n = (B.table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    status = lambda s: F.count_if(F.col("o_orderstatus") == s).alias(s.lower())
    return joined.groupBy(F.col("n_name").alias("nation"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(status("F"), status("O"), status("P"), R(F.min("o_totalprice")).alias("low"))


PW = "(order by date rows between 60 preceding and 1 preceding)"


@query(sql("gidx mkt", f"select date, round(gap, 4) as gap, abs(gap) > 1 as signal from (select date, case when count(*) over p >= 20 then (a - avg(a) over p) / nullif(stddev_samp(a) over p, 0) - (b - avg(b) over p) / nullif(stddev_samp(b) over p, 0) end as gap from (select date, ln(1 + value) as a, ln(price) as b from gidx join mkt using (date)) window p as {PW}) where gap is not null"))
def p11_divergence(spark, sf):
    both = B.global_index(spark, sf).join(B.market(spark, sf), "date").select("series_id", "date", F.log1p("value").alias("a"), F.log("price").alias("b"))
    return rounded(indices.divergence(both, "a", "b").where("gap is not null").select("date", "gap", "signal"), "gap")


@query(sql("idx", "select series_id, date, avg(case when b <= a then 1.0 else 0 end) > 0.9 as regime from (select x.series_id, x.date, x.value as a, y.value as b from idx x join idx y on y.series_id = x.series_id and y.date between x.date - 365 and x.date) group by 1, 2"))
def p12_regime(spark, sf):
    from tremor.operators.windows import percent_rank_year

    return percent_rank_year(B.index(spark, sf)).select("series_id", "date", (F.col("pct_rank") > 0.9).alias("regime"))


def signal_and_return(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("date")
    i = B.index(spark, sf).join(B.market(spark, sf).select("date", F.log("price").alias("y")), "date")
    return i.select("series_id", "date", (F.log1p("value") - 5).alias("signal"), (F.col("y") - F.lag("y").over(w)).alias("ret"))


SIGNAL = "select series_id, date, ln(1 + value) - 5 as signal, ln(price) - lag(ln(price)) over (partition by series_id order by date) as ret from idx join mkt using (date)"


@query(
    sql(
        "idx mkt",
        "select series_id, horizon, round(corr(signal, later), 4) as ic, round(corr(rs, rl), 4) as rank_ic, round(avg(case when sign(signal) = sign(later) then 1 else 0 end), 4) as hit from (select *, rank() over (partition by series_id, horizon order by signal) as rs, rank() over (partition by series_id, horizon order by later) as rl from l where later is not null and signal is not null) group by 1, 2",
        s=SIGNAL,
        l="select series_id, h.horizon, signal, lead(ret, cast(h.horizon as int)) over (partition by series_id, h.horizon order by date) as later from s cross join (values (5), (20), (60)) h(horizon)",
    )
)
def p13_information_coefficient(spark, sf):
    return rounded(indices.information_coefficient(signal_and_return(spark, sf), "signal", "ret", [5, 20, 60]), "ic", "rank_ic", "hit")


@query(
    sql(
        "idx",
        "select series_id, fold, part, count(*) as n from (select i.series_id, f.fold, case when date between a and cast(t - interval 11 day as date) then 'train' when date between t and cast(t + interval 1 year - interval 1 day as date) then 'test' end as part from idx i join f on true) where part is not null group by 1, 2, 3",
        f="select cast(k as int) as fold, cast(date '1995-01-01' + to_years(cast(k as int)) as date) as a, cast(date '1995-01-01' + to_years(cast(k + 3 as int)) as date) as t from range(3) r(k)",
    )
)
def p14_folds(spark, sf):
    made = indices.folds(spark, "1995-01-01", "2001-06-01")
    return indices.tag_folds(B.index(spark, sf), made).groupBy("series_id", "fold", "part").agg(F.count("*").alias("n"))


@query(
    sql(
        "idx mkt",
        "select series_id, count(*) as days, round(exp(sum(ln(1 + net))) - 1, 4) as total, round(avg(net) * sqrt(252.0) / stddev_samp(net), 4) as sharpe, round(min(exp(lw - greatest(top, 0)) - 1), 4) as drawdown, round(sum(turn), 4) as turnover from v group by 1",
        s=SIGNAL,
        h="select *, coalesce(lag(case when signal > 0 then 1.0 else 0.25 end) over (partition by series_id order by date), 0) as held from s",
        u="select *, abs(held - coalesce(lag(held) over (partition by series_id order by date), 0)) as turn from h",
        g="select *, held * ret / 10 - 0.0005 * turn as net from u where ret is not null",
        w="select *, sum(ln(1 + net)) over (partition by series_id order by date) as lw from g",
        v="select *, max(lw) over (partition by series_id order by date) as top from w",
    )
)
def p15_strategy(spark, sf):
    rows = signal_and_return(spark, sf).withColumn("ret", F.col("ret") / 10)
    position = F.when(F.col("signal") > 0, 1.0).otherwise(0.25)
    return rounded(indices.backtest(rows, position), "total", "sharpe", "drawdown", "turnover")


@query("select grp, name, round(p, 6) as p, round(least(1, max(a) over (partition by grp order by p, name rows unbounded preceding)), 6) as p_holm from (select *, (count(*) over (partition by grp) - row_number() over (partition by grp order by p, name) + 1) * p as a from (select event_type as grp, user_id as name, cast(sum(cast(value as decimal(18,2))) as double) / count(*) / 9973 as p from events group by 1, 2))")
def p21_holm(spark, sf):
    tests = B.table(spark, sf, "events").groupBy(F.col("event_type").alias("grp"), F.col("user_id").alias("name")).agg((B.money("value") / F.count("*") / 9973).alias("p"))  # a prime: no p on the edge of a rounding step
    return rounded(indices.holm(tests, "grp"), "p", "p_holm", digits=6)


@query("select source, doc_id, toxic as score, n from (select source, doc_id, toxic, row_number() over (partition by source order by toxic desc, n_chars desc, doc_id) as n from documents join labels using (doc_id)) where n <= 3")
def p24_top_documents(spark, sf):
    d = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id")
    w = Window.partitionBy("source").orderBy(F.desc("toxic"), F.desc("n_chars"), "doc_id")
    return d.select("source", "doc_id", F.col("toxic").alias("score"), F.row_number().over(w).cast("long").alias("n")).where("n <= 3")


@query("select round(1 - (n - same) / (n - pairs / (n - 1)), 4) as alpha from (select sum(c * (c - 1) / (m - 1)) as same, sum(c) * 1.0 as n from k), (select sum(t * (t - 1)) as pairs from (select rating, sum(c) * 1.0 as t from k group by 1))".replace("from k", "from (select *, sum(c) over (partition by unit) as m from (select user_id as unit, event_type as rating, count(*) as c from events group by 1, 2)) k"))
def p20_agreement(spark, sf):
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("unit"), F.col("event_type").alias("rating"))
    return rounded(indices.agreement(e), "alpha")


@query("select q.vec_id as query_id, v.vec_id, rank from (select q.vec_id as a, v.vec_id as b, row_number() over (partition by q.vec_id order by list_cosine_similarity(q.embedding::double[], v.embedding::double[]) desc, v.vec_id) as rank from embeddings q, embeddings v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id) r join embeddings q on q.vec_id = a join embeddings v on v.vec_id = b where rank <= 5")
def p18_analogues(spark, sf):
    """Exact nearest neighbours of the stated query set, ids divisible by 20, against all rows."""
    v = B.table(spark, sf, "embeddings")
    near = indices.neighbours(v, v.where("vec_id % 20 = 0"), 5)
    return near.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("with k as (select user_id as unit, cast(floor(value / 50) as int) as rating, count(*) as c from events group by 1, 2), g as (select *, sum(c) over (partition by unit) as m from k), u as (select * from g where m > 1), t as (select rating, sum(c) as n from u group by 1), d as (select a.rating as x, b.rating as y, power((select sum(n) from t where rating between least(a.rating, b.rating) and greatest(a.rating, b.rating)) - (a.n + b.n) / 2.0, 2) as d, a.n * b.n as nn from t a, t b) select round(1 - (select sum(a.c * b.c * d / (a.m - 1.0)) from u a join u b on a.unit = b.unit join d on x = a.rating and y = b.rating) / ((select sum(nn * d) from d) / ((select sum(n) from t) - 1.0)), 4) as alpha")
def p20_ordinal_agreement(spark, sf):
    """Ordinal agreement of the events' value bands by user."""
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("unit"), F.floor(F.col("value") / 50).cast("int").alias("rating"))
    return rounded(indices.ordinal_agreement(e), "alpha")


@query("select lang, round(covar_pop(toxic, size) / nullif(stddev_pop(toxic) * stddev_pop(size), 0), 4) as correlation, count(*) as n from (select lang, toxic, ln(1 + length(text)) as size from documents join labels using (doc_id) where text is not null) group by 1")
def p20_human_machine(spark, sf):
    """How a human label goes with a measure of the text, by language."""
    a = articles(spark, sf).where("text is not null").withColumn("size", F.log1p(F.length("text")))
    return a.groupBy("lang").agg(R(indices.correlation("score", "size")).alias("correlation"), F.count("*").alias("n"))


TAUS = (0.1, 0.5, 0.9)
RECENT = "(partition by series_id order by date rows between 60 preceding and 1 preceding)"


@query(
    sql(
        "idx",
        "select series_id, count(*) as n, round(avg(power(chance - case when value > 150 then 1 else 0 end, 2)), 6) as brier, round(avg(2.0 / 3 * (" + " + ".join(f"case when value >= q{int(t * 100)} then {t} * (value - q{int(t * 100)}) else (1 - {t}) * (q{int(t * 100)} - value) end" for t in TAUS) + ")), 4) as crps from f where n >= 20 group by 1",
        f=f"select *, count(*) over p as n, avg(case when value > 150 then 1.0 else 0 end) over p as chance, " + ", ".join(f"quantile_cont(value, {t}) over p as q{int(t * 100)}" for t in TAUS) + f" from idx window p as {RECENT}",
    )
)
def p19_forecast_scores(spark, sf):
    """Climatology of the last 60 values as forecast: its chance of a high day and its quantiles."""
    i, x = B.index(spark, sf), F.col("value")
    high = (x > 150).cast("int")
    made = i.withColumns({"chance": windows.over_past(F.avg, high, 60, 20), "high": high, **{f"q{int(t * 100)}": windows.over_past(windows.quantile(t), x, 60, 20) for t in TAUS}})
    out = indices.forecast_scores(made, "chance", "high", "value", {t: f"q{int(t * 100)}" for t in TAUS})
    return rounded(rounded(out, "brier", digits=6), "crps")


EPISODE = ("shock", "step", "y", "ctrl")
Z = ", ".join(f"coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0)" for c in EPISODE)


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's descriptor: the index, its change, the market and the control."""
    w = Window.partitionBy("panel_id").orderBy("t")
    p = B.panel(spark, sf).select("panel_id", F.col("t").cast("long").alias("id"), F.datediff("date", F.lit("1970-01-01")).cast("long").alias("at"), "shock", (F.col("shock") - F.lag("shock").over(w)).alias("step"), "y", "ctrl", "t")
    return analogues.standardised(p, EPISODE).select("id", "at", "vector")


@query(
    sql(
        "panel",
        "select q as query_id, horizon, n, case when n >= 5 then round(mid, 6) end as median, case when n >= 5 then round(lo, 6) end as low, case when n >= 5 then round(hi, 6) end as high, case when n >= 5 then round(case when mid > 0 then up when mid < 0 then down else 1 - up - down end, 6) end as same_sign, case when n < 5 then 'silent' when lo * hi < 0 then 'dispersed' else 'clear' end as verdict from (select q, horizon, count(*) as n, quantile_cont(v, 0.25) as lo, quantile_cont(v, 0.5) as mid, quantile_cont(v, 0.75) as hi, avg(case when v > 0 then 1 else 0 end) as up, avg(case when v < 0 then 1 else 0 end) as down from r join o using (id) where v is not null group by 1, 2)",
        d="select t as id, date, shock, shock - lag(shock) over (order by t) as step, y, ctrl from panel",
        z=f"select id, date, [{Z}] as vec from d where step is not null",
        r="select q, id from (select a.id as q, b.id, row_number() over (partition by a.id order by list_cosine_similarity(a.vec, b.vec) desc, b.id) as k from z a join z b on b.date < a.date - 30 where a.id % 20 = 0) where k <= 12",
        o="select t as id, unnest([5, 20]) as horizon, unnest([lead(y, 5) over (order by t) - y, lead(y, 20) over (order by t) - y]) as v from panel",
    )
)
def p18_paths(spark, sf):
    """What followed the twelve most similar earlier days, those of the last 30 days left out, for every twentieth day."""
    rows = written(episodes(spark, sf), "episodes")
    found = analogues.nearest(rows, rows.where("id % 20 = 0"), 12, apart=30, past=True)
    w = Window.partitionBy("panel_id").orderBy("t")
    outcomes = B.panel(spark, sf).select(F.col("t").cast("long").alias("id"), F.array(*(F.struct(F.lit(h).alias("horizon"), (F.lead("y", h).over(w) - F.col("y")).alias("value")) for h in (5, 20))).alias("e")).select("id", F.explode("e").alias("e")).select("id", "e.*")
    return rounded(analogues.paths(found, outcomes), "median", "low", "high", "same_sign", digits=6)


@query("select event_type as series_id, cast(date_trunc('day', ts) as timestamp) as start, count(*) as n, round(avg(value) * 1000 / 997, 4) as mean from events group by 1, 2")
def st01_windowed_index(spark, sf):
    out = live.replay(spark, live.source(spark, sf), live.windowed_index, "st01", ["series_id", "start"])
    return out.withColumn("mean", R(F.col("mean") * 1000 / B.UNIT))


@query("select user_id, event_type, min(ts) as ts from events group by user_id, event_type, cast(ts as date)")
def st02_dedup(spark, sf):
    out = live.replay(spark, live.source(spark, sf), live.first_of_day, "st02", ["user_id", "event_type", "day"])
    return out.drop("day")


@query("select user_id, min(ts) as start, max(ts) as last, count(*) as n from (select *, sum(new) over (partition by user_id order by ts) as s from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 12 hour then 0 else 1 end as new from events)) group by user_id, s")
def st04_sessions(spark, sf):
    """All sessions, in append mode; those open at the last event are closed by a mark behind it."""
    return live.appended_to_end(spark, sf, live.sessions, "st04", "start")


@query("select event_id from (select event_id, row_number() over (partition by user_id, event_type, value order by ts) as n from events) where n = 1")
def st02_content_dedup(spark, sf):
    """ST2 by content: each day's first in append mode, then the first of the days."""
    told = live.appended_to_end(spark, sf, live.first_of_content, "st02c", "day")
    return told.groupBy("user_id", "event_type", "value").agg(F.min("first").alias("first")).select("first.event_id")


@query(
    """select user_id as actor, ts from (select user_id, ts from events where event_type = 'purchase') a
where not exists (select 1 from events b where b.event_type = 'click' and b.user_id = a.user_id and b.ts > a.ts and b.ts <= a.ts + interval 3 days)
and a.ts + interval 3 days < (select least((select max(ts) from events where event_type = 'purchase'), (select max(ts) from events where event_type = 'click'))) - interval 1 day"""
)
def st07_unanswered(spark, sf):
    """Purchases that no click of the user follows within three days, once the watermark has passed them."""
    e = lambda kind: live.source(spark, sf).where(F.col("event_type") == kind).select(F.col("user_id").alias("actor"), "ts")
    return live.appended(spark, live.unanswered(e("purchase"), e("click")), "st07")
