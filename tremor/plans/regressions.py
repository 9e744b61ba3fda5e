"""Queries of regressions, impulse responses, transmission and specification curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators import gram, inference, response, speccurve, timealign, transforms
from tremor.operators import windows as W

from . import base as B
from . import lsq_sql as Q
from .base import Query, R, rounded, sql
from .series import JUMPED, SAMPLES, samples

QUERIES: dict[str, Query] = {}


def query(text: str | None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """How the daily index's innovation, known a day late, moves the market price over the next five decision days."""
    g = B.global_index(spark, sf).withColumn("value", F.log1p("value"))
    shock = W.innovation(g, 1).select("series_id", "date", F.col("innovation").alias("value")).where("value is not null")
    rolled = timealign.roll_forward(shock, B.days(spark, sf), lag=1).select(F.col("decision_day").alias("date"), F.col("value").alias("shock"))
    y = B.market(spark, sf).select("date", F.log("price").alias("y"))
    both = y.join(rolled, "date").dropna().withColumn("panel_id", F.lit("daily"))
    rows = both.withColumns({"t": F.row_number().over(Window.partitionBy("panel_id").orderBy("date")), "y_l1": F.lag("y").over(Window.partitionBy("panel_id").orderBy("date"))})
    irf = gram.local_projection(rows, ["panel_id"], "y", "shock", ["y_l1"], range(6))
    return rounded(irf.select("horizon", "beta", "se", "p", "lo", "hi", "nobs"), "beta", "se", "p", "lo", "hi", digits=6)


@query(None)
def flagship_irf(spark, sf):
    return flagship(spark, sf)


@query(sql("idx mkt", "select series_id, 'x' as term, round(regr_slope(y, x), 4) as beta, round(regr_intercept(y, x), 4) as intercept, round(regr_r2(y, x), 4) as r2, regr_count(y, x) as nobs, round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)), 4) as se from (select series_id, ln(price) as y, ln(1 + value) as x from idx join mkt using (date)) group by 1"))
def r01_ols(spark, sf):
    rows = B.index(spark, sf).join(B.market(spark, sf), "date").select("series_id", F.log("price").alias("y"), F.log1p("value").alias("x"))
    out = gram.ols_table(rows, ["series_id"], "y", ["x"])
    return rounded(out.select("series_id", "term", "beta", "intercept", "r2", "nobs", "se"), "beta", "intercept", "r2", "se")


STACK = "select * from (select t, h.horizon, shock / 1000 as x, lead(y, cast(h.horizon as int)) over (partition by h.horizon order by t) as yl from panel cross join (values (0), (1), (2), (5)) h(horizon)) where yl is not null and x is not null"
LEADS = lambda hs: "select * from (select h.horizon, t, shock / 1000 as x, ln(1 + shock) as x2, y2, ctrl, lead(y, cast(h.horizon as int)) over w as yl, lead(y2, cast(h.horizon as int)) over w as yl2, y, " + ", ".join(f"lag({c}, {m}) over w as {n}{m}" for c, n in (("y", "y_"), ("shock / 1000", "x_"), ("y2", "z_")) for m in (1, 2)) + f" from panel cross join (values {', '.join(f'({h})' for h in hs)}) h(horizon) window w as (partition by h.horizon order by t))"  # noqa: E731, E501
PSI = "select s.horizon, t, (x - mx) * (yl - my - b * (x - mx)) / sxx as psi from s join f using (horizon)"
FIT = "select horizon, avg(x) as mx, avg(yl) as my, regr_slope(yl, x) as b, regr_sxx(yl, x) as sxx, count(*) as n from s group by 1"


def short_panel(spark: SparkSession, sf: str) -> DataFrame:
    return B.panel(spark, sf).withColumn("x", F.col("shock") / 1000)


@query(
    sql(
        "panel",
        "select f.horizon, round(b, 6) as beta, round(sqrt(v), 6) as se, n as nobs from f join (select horizon, sum(psi * psi) + 2 * sum(psi * (" + " + ".join(f"{1 - m / 6!r} * coalesce(lag{m}, 0)" for m in range(1, 6)) + ")) as v from (select horizon, psi, " + ", ".join(f"lag(psi, {m}) over (partition by horizon order by t) as lag{m}" for m in range(1, 6)) + " from p) group by 1) using (horizon)",
        s=STACK,
        f=FIT,
        p=PSI,
    )
)
def r05_local_projection_hac(spark, sf):
    """R2, R4 and R5: Newey-West with max(5, h) lags at every horizon."""
    irf = gram.local_projection(short_panel(spark, sf), ["panel_id"], "y", "x", (), [0, 1, 2, 5])
    return rounded(irf.select("horizon", "beta", "se", "nobs"), "beta", "se", digits=6)


@query(sql("panel", "select f.horizon, round(b, 6) as beta, round(sqrt(sum(psi * psi) * n / (n - 2)), 6) as se, n as nobs from f join p using (horizon) group by f.horizon, b, n", s=STACK, f=FIT, p=PSI))
def r03_hc1(spark, sf):
    rows = timealign.leads(short_panel(spark, sf), "y", [0, 1, 2, 5], ("panel_id",))
    fitted = gram.fit(rows, ["horizon"], "y_lead", ["x"])
    psi = gram.influence(rows, fitted, ["horizon"], "y_lead", ["x"])
    return rounded(gram.inference(psi, fitted, ["horizon"], ["x"], [0], kind="hc1").select("horizon", "beta", "se", "nobs"), "beta", "se", digits=6)


LAGGED = ["ctrl", "y_1", "y_2", "x_1", "x_2"]


@query(sql("panel", f"select horizon, round(b, 6) as beta, round(se, 6) as se, n as nobs from ({Q.hc1('q', ['horizon'], 6)})", s=LEADS(range(6)), **Q.partial("s", ["horizon"], "yl", "x", LAGGED)))
def r06_lag_augmented(spark, sf):
    irf = gram.local_projection(short_panel(spark, sf), ["panel_id"], "y", "x", ["ctrl"], range(6), kind="lag_augmented", lags=2)
    return rounded(irf.select("horizon", "beta", "se", "nobs"), "beta", "se", digits=6)


ORTH = "select c.series_id, c.date, round(x - (avg(x) over w + regr_slope(x, g) over w * (g - avg(g) over w)), 4) as orth from (select series_id, date, ln(1 + value) as x, g from ctry join gm using (date)) c window w as (partition by series_id)"


@query(sql("gidx ctry", ORTH, gm="select cast(date_trunc('month', date) as date) as date, avg(ln(1 + value)) as g from gidx group by 1"))
def r09_orthogonal(spark, sf):
    g = B.global_index(spark, sf).groupBy(F.trunc("date", "MM").alias("date")).agg(F.avg(F.log1p("value")).alias("g"))
    c = B.countries(spark, sf).withColumn("x", F.log1p("value")).join(g, "date")
    return rounded(gram.orthogonal(c, ["series_id"], "x", ["g"], "orth").select("series_id", "date", "orth"), "orth")


@query(
    sql(
        "idx",
        "select series_id, 0 as p, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * 2, 4) as bic, n as nobs from (select series_id, var_pop(v) * count(*) as rss, count(*) as n from d group by 1) union all select series_id, 1, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * 3, 4), n from (select series_id, regr_syy(v, l) * (1 - regr_r2(v, l)) as rss, regr_count(v, l) as n from d group by 1)",
        d="select series_id, ln(1 + value) as v, lag(ln(1 + value)) over (partition by series_id order by date) as l from idx where date <= date '1998-12-31'",
    )
)
def r10_ar_order_criteria(spark, sf):
    dev = transforms.between(B.index(spark, sf), None, "1998-12-31").withColumn("value", F.log1p("value"))
    return rounded(gram.ar_orders(dev, top=1), "bic")


def _ar_order_sql() -> str:
    lags = ", ".join(f"lag(ln(1 + value), {m}) over w as l{m}" for m in range(1, 6))
    dev = f"select series_id, 0 as t, ln(1 + value) as v, count(*) over (partition by series_id) as many, {lags} from idx where date <= date '1998-12-31' window w as (partition by series_id order by date)"
    steps = {"d": dev, "o0": "select series_id, 0 as p, var_pop(v) * count(*) as rss, count(*) as n from d group by 1"}
    for p in range(1, 6):
        steps |= {f"d{p}": f"select * from d where many >= {5 * p}"} | Q.partial(f"d{p}", ["series_id"], "v", "l1", [f"l{m}" for m in range(2, p + 1)], f"q{p}_")
    each = " union all ".join(["select * from o0", *(f"select series_id, {p}, rss, n from q{p}_b where n > {p + 1}" for p in range(1, 6))])
    return sql("idx", f"select series_id, cast(arg_min(p, n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * (p + 2)) as int) as p from ({each}) where n >= 10 and rss > 0 group by 1", **steps)


@query(_ar_order_sql())
def r10_ar_order(spark, sf):
    dev = transforms.between(B.index(spark, sf), None, "1998-12-31").withColumn("value", F.log1p("value"))
    return gram.best_order(gram.ar_orders(dev, top=5))


def _tier2_sql() -> str:
    steps, parts = {}, []
    for k, (macro, shock, lead, own) in enumerate((m, x, yl, c) for m, yl, c in (("y", "yl", "y_1"), ("y2", "yl2", "z_1")) for x in ("x", "x2")):
        steps |= Q.partial("s", ["horizon"], lead, shock, [own], f"q{'abcd'[k]}")
        parts.append(f"select '{macro}' as macro, '{shock}' as shock, horizon, round(b, 6) as beta, round(se, 6) as se, n as nobs from ({Q.hac(f'q{chr(97 + k)}', ['horizon'], 5)})")
    return sql("panel", " union all ".join(parts), s=LEADS(range(6)), **steps)


@query(_tier2_sql())
def r11_tier2(spark, sf):
    p = short_panel(spark, sf).withColumn("x2", F.log1p("shock"))
    return rounded(response.tier2(p, ["y", "y2"], ["x", "x2"], range(6)).select("macro", "shock", "horizon", "beta", "se", "nobs"), "beta", "se", digits=6)


def small_irf(spark: SparkSession, sf: str) -> DataFrame:
    """Country responses of the price to each priority's index: (series_id, horizon, beta, p)."""
    i = B.index(spark, sf).join(B.market(spark, sf).select("date", F.log("price").alias("y")), "date").withColumn("x", F.log1p("value"))
    i = i.withColumn("t", F.row_number().over(Window.partitionBy("series_id").orderBy("date")))
    return gram.local_projection(i, ["series_id"], "y", "x", (), range(4))


IRF_STACK = "select * from (select series_id, h.horizon, x, t, lead(y, cast(h.horizon as int)) over (partition by series_id, h.horizon order by t) as yl from (select series_id, row_number() over (partition by series_id order by date) as t, ln(price) as y, ln(1 + value) as x from idx join mkt using (date)) cross join (values (0), (1), (2), (3)) h(horizon)) where yl is not null"
IRF_BETA = "select series_id, horizon, regr_slope(yl, x) as beta, stddev_samp(x) as sx, stddev_samp(yl) as sy, count(*) as n from s group by 1, 2"


@query(sql("idx mkt", "select series_id, horizon, round(beta, 6) as beta from f where horizon = 0", s=IRF_STACK, f=IRF_BETA))
def d15_impact(spark, sf):
    return rounded(response.impact(small_irf(spark, sf)).select("series_id", "horizon", "beta"), "beta", digits=6)




# Two-sided normal p below a level is |t| above its quantile; small_irf takes three Newey-West lags.
IRF_T = f"select series_id, horizon, b as beta, b / se as t, n from ({Q.hac('q', ['series_id', 'horizon'], 3)})"
IRF = {"s": IRF_STACK, **Q.partial("s", ["series_id", "horizon"], "yl", "x"), "irf": IRF_T}
Z90, Z95, Z_CLIPPED = 1.6448536269514722, 1.959963984540054, 7.130550990741301  # normal quantiles of 0.95, 0.975, 1 - 5e-13


@query(sql("idx mkt", f"select series_id, bool_or(beta < 0 and abs(t) > {Z90}) as replicated, round(min(beta), 6) as trough, cast(arg_min(horizon, beta) as int) as trough_horizon from irf where horizon between 1 and 3 group by 1", **IRF))
def d16_trough(spark, sf):
    return rounded(response.replication(small_irf(spark, sf), ["series_id"], 1, 3), "trough", digits=6)


@query(sql("idx mkt", f"select series_id, round(avg(case when abs(t) > {Z90} then 1 else 0 end), 6) as share, round(max(case when abs(t) > {Z90} then abs(beta) end), 6) as peak, cast(arg_max(horizon, abs(beta)) filter (abs(t) > {Z90}) as int) as peak_horizon from irf group by 1", **IRF))
def d14_significance(spark, sf):
    return rounded(response.significance(small_irf(spark, sf), ["series_id"]), "share", "peak", digits=6)


@query(sql("idx mkt", "select f.series_id, horizon, round(beta * b.sx / b.sy, 6) as beta_std from f join (select series_id, stddev_samp(x) as sx, stddev_samp(y) as sy from (select series_id, ln(price) as y, ln(1 + value) as x from idx join mkt using (date)) group by 1) b using (series_id)", s=IRF_STACK, f=IRF_BETA))
def b16_standardised(spark, sf):
    i = B.index(spark, sf).join(B.market(spark, sf).select("date", F.log("price").alias("y")), "date").withColumn("x", F.log1p("value"))
    spread = i.groupBy("series_id").agg(F.stddev_samp("x").alias("sd_shock"), F.stddev_samp("y").alias("sd_y"))
    return rounded(response.standardised(small_irf(spark, sf), spread, ["series_id"]).select("series_id", "horizon", "beta_std"), "beta_std", digits=6)


@query(
    sql(
        "idx mkt",
        "select channel, horizon, round(sum(v), 6) as indirect from (select c.channel, horizon, v from (select g.series_id as channel, g.horizon + t.horizon as horizon, g.beta * t.beta as v from f g join f t using (series_id) where g.horizon + t.horizon <= 3) x, lateral (select unnest([x.channel, null]) as channel) c) group by 1, 2",
        s=IRF_STACK,
        f=IRF_BETA,
    )
)
def r15_convolution(spark, sf):
    irf = small_irf(spark, sf).withColumnRenamed("series_id", "channel")
    return rounded(response.convolve(irf, irf, 3), "indirect", digits=6)


@query(
    sql(
        "idx mkt",
        "select i.horizon, round(coalesce(d.beta, 0), 6) as direct, round(i.v, 6) as indirect, round(coalesce(d.beta, 0) + i.v, 6) as total, round(m.beta, 6) as domestic from (select g.horizon + t.horizon as horizon, sum(g.beta * t.beta) as v from f g join f t using (series_id) where g.horizon + t.horizon <= 3 group by 1) i left join (select * from f where series_id = '1-URGENT' and horizon < 2) d using (horizon) left join (select * from f where series_id = '5-LOW') m on m.horizon = i.horizon",
        s=IRF_STACK,
        f=IRF_BETA,
    )
)
def r16_transmission(spark, sf):
    irf = small_irf(spark, sf).withColumnRenamed("series_id", "channel")
    out = response.transmission(response.convolve(irf, irf, 3), irf.where("channel = '1-URGENT' and horizon < 2"), irf.where("channel = '5-LOW'"))
    return rounded(out, "direct", "indirect", "total", "domestic", digits=6)


def country_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly by nation: t, ret, dom (own index), world, price, disc."""
    long = timealign.monthly(B.market_long(spark, sf).where("series_id in ('price', 'disc')"))
    m = long.groupBy(F.col("month").alias("date")).pivot("series_id", ["price", "disc"]).agg(F.first("value"))
    g = B.global_index(spark, sf).groupBy(F.trunc("date", "MM").alias("date")).agg(F.avg(F.log1p("value")).alias("world"))
    c = B.countries(spark, sf).withColumn("dom", F.log1p("value")).join(g, "date").join(m, "date")
    w = Window.partitionBy("series_id").orderBy("date")
    return c.select("series_id", "date", "dom", "world", F.log("price").alias("price"), "disc", (F.log1p("value") - F.lag(F.log1p("value")).over(w)).alias("ret"), F.row_number().over(w).alias("t"))


COUNTRY = {
    "gm": "select cast(date_trunc('month', date) as date) as date, avg(ln(1 + value)) as world from gidx group by 1",
    "mm": "select cast(date_trunc('month', date) as date) as date, arg_max(price, date) as price, arg_max(disc, date) as disc from mkt group by 1",
    "cp": "select series_id, date, ln(1 + value) as dom, world, ln(price) as price, disc, ln(1 + value) - lag(ln(1 + value)) over w as ret, row_number() over w as t from ctry join gm using (date) join mm using (date) window w as (partition by series_id order by date)",
}


def _country_leads(y: str, horizons: int) -> str:
    hs = ", ".join(f"({h})" for h in range(horizons))
    return f"select *, lead({y}, cast(h.horizon as int)) over (partition by series_id, h.horizon order by t) as yl, lag(dom) over (partition by series_id, h.horizon order by t) as moved from cp cross join (values {hs}) h(horizon)"


def _tier3_sql() -> str:
    steps, parts, terms = {}, [], {"world": "beta", "price": "theta", "dom": "lambda", "disc": "control"}
    for k, (term, role) in enumerate(terms.items()):
        steps |= Q.partial("s", ["series_id", "horizon"], "yl", term, [c for c in terms if c != term], f"q{chr(97 + k)}")
        parts.append(f"select series_id, horizon, '{term}' as term, '{role}' as role, round(b, 4) as beta, round(se, 4) as se, n as nobs from ({Q.hac(f'q{chr(97 + k)}', ['series_id', 'horizon'], 2)})")
    return sql("gidx ctry mkt", " union all ".join(parts), **COUNTRY, s=_country_leads("ret", 3), **steps)


@query(_tier3_sql())
def r14_tier3(spark, sf):
    irf = response.tier3(country_panel(spark, sf), ["series_id"], "ret", ["price"], "dom", ["world"], ["disc"], range(3))
    return rounded(irf.select("series_id", "horizon", "term", "role", "beta", "se", "nobs"), "beta", "se")


def _shapley_sql() -> str:
    """R2 of each subset of channels with the control always in, and the weighted gains of each channel."""
    channels = ["dom", "world", "price"]
    steps, gains = {}, []
    for mask in range(8):
        steps |= Q.partial("s", ["series_id"], "ret", "disc", [c for i, c in enumerate(channels) if mask >> i & 1], f"q{mask}_")
    weight = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}
    for i, c in enumerate(channels):
        share = " + ".join(f"{weight[bin(m).count('1')]!r} * (q{m}_b.rss - q{m | 1 << i}_b.rss)" for m in range(8) if not m >> i & 1)
        gains.append(f"select series_id, '{c}' as channel, round(({share}) / tss, 4) as share, round(1 - q7_b.rss / tss, 4) as r2_full, round(1 - q0_b.rss / tss, 4) as r2_base from tss " + " ".join(f"join q{m}_b using (series_id)" for m in range(8)))
    whole = "select * from cp where ret is not null and dom is not null and world is not null and price is not null and disc is not null"
    return sql("gidx ctry mkt", " union all ".join(gains), **COUNTRY, s=whole, tss="select series_id, var_pop(ret) * count(*) as tss from s group by 1", **steps)


@query(_shapley_sql())
def r17_shapley(spark, sf):
    return rounded(gram.shapley_r2(country_panel(spark, sf), ["series_id"], "ret", ["dom", "world", "price"], ["disc"]), "share", "r2_full", "r2_base")


VAR_LAGS = "select series_id, t, dom, world, price, " + ", ".join(f"lag({c}, {m}) over w as {c}_l{m}" for c in ("dom", "world", "price") for m in (1, 2)) + " from cp window w as (partition by series_id order by t)"


def _block_var_sql() -> str:
    steps, parts, mine = {}, [], [f"{c}_l{m}" for c in ("world", "price") for m in (1, 2)]
    for equation in ("world", "price", "dom"):
        xs = mine if equation != "dom" else [*mine, "dom_l1", "dom_l2"]
        for x in xs:
            name = f"q{len(parts)}_"
            steps |= Q.partial("s", ["series_id"], equation, x, [c for c in xs if c != x], name)
            parts.append(f"select series_id, '{equation}' as equation, '{x}' as regressor, round(b, 4) as coef, round(rss, 4) as rss, n as nobs from {name}b")
    return sql("gidx ctry mkt", " union all ".join(parts), **COUNTRY, s=VAR_LAGS, **steps)


@query(_block_var_sql())
def r18_block_var(spark, sf):
    return rounded(gram.block_var(country_panel(spark, sf), ["world", "price"], ["dom"], 2), "coef", "rss")


@query(None)
def r19_block_granger(spark, sf):
    return rounded(gram.block_granger(country_panel(spark, sf), ["world", "price"], ["dom"], 2), "f", "p")


def _granger_sql() -> str:
    steps, mine = {}, [f"{c}_l{m}" for c in ("world", "price") for m in (1, 2)]
    for c in ("world", "price"):
        steps |= Q.partial("s", ["series_id"], c, mine[0], mine[1:], f"{c}0_") | Q.partial("s", ["series_id"], c, mine[0], [*mine[1:], "dom_l1", "dom_l2"], f"{c}1_")
    body = "select series_id, round(((world0_b.rss + price0_b.rss - world1_b.rss - price1_b.rss) / 4) / ((world1_b.rss + price1_b.rss) / (2 * (world1_b.n - 7))), 4) as f, 4 as q, 2 * (world1_b.n - 7) as dof from world0_b join price0_b using (series_id) join world1_b using (series_id) join price1_b using (series_id)"
    whole = f"select * from ({VAR_LAGS}) where dom_l2 is not null and world_l2 is not null and price_l2 is not null and world is not null and price is not null"
    return sql("gidx ctry mkt", body, **COUNTRY, s=whole, **steps)


@query(_granger_sql())
def r19_granger_statistic(spark, sf):
    """R19 without its p-value, for which SQL has no F tail; tests hold that against tables."""
    return rounded(gram.block_granger(country_panel(spark, sf), ["world", "price"], ["dom"], 2).drop("p"), "f")


BLOCK, DRAWS = 20, 1000  # the protocol's number of draws
SIZE = "(select count(*) from panel)"
DRAW = f"""b0 as (select b, k, (1 * 7919 + b * 104729 + 12345) % 1000003 as x from range({DRAWS}) r(b) cross join (select unnest(range(cast(ceil({SIZE} / {BLOCK}.0) as bigint))) as k) s),
b1 as (select b, k, (x * x + x * 31 + 7) % 1000003 as x from b0), b2 as (select b, k, (x * 7919 + k * 104729 + 12345) % 1000003 as x from b1),
st as (select b, k, ((x * x + x * 31 + 7) % 1000003) % ({SIZE} - {BLOCK} + 1) as start from b2),
ix as (select b, k * {BLOCK} + j as pos, start + j as source from st cross join range({BLOCK}) t(j) where k * {BLOCK} + j < {SIZE})"""


@query(sql("panel", "") + f", {DRAW} select b, round(avg(shock), 4) as mean, cast(sum(source) as bigint) as total from ix join panel on t = source + 1 group by 1")
def c01_block_bootstrap(spark, sf):
    rows = B.panel(spark, sf).select((F.col("t") - 1).cast("long").alias("source"), "shock")
    drawn = speccurve.block_indices(spark, rows.count(), BLOCK, DRAWS)
    return drawn.join(rows, "source").groupBy("b").agg(R(F.avg("shock")).alias("mean"), F.sum("source").cast("long").alias("total"))


@query(sql("idx mkt", "select horizon, case when avg(case when beta > 0 then 1 else 0 end) >= avg(case when beta < 0 then 1 else 0 end) then 1 else -1 end as sign, round(greatest(avg(case when beta > 0 then 1 else 0 end), avg(case when beta < 0 then 1 else 0 end)), 4) as share, round(quantile_cont(beta, 0.5), 6) as median from f group by 1", s=IRF_STACK, f=IRF_BETA))
def c02_dominant_sign(spark, sf):
    sign, share = speccurve.sign_share(F.col("beta"))
    return small_irf(spark, sf).groupBy("horizon").agg(sign.alias("sign"), R(share).alias("share"), R(F.percentile("beta", F.lit(0.5)), 6).alias("median"))


@query(
    sql(
        "idx mkt",
        f"select horizon, round(quantile_cont(beta, 0.5), 6) as median, round(avg(case when abs(t) > {Z95} and sign(beta) = m then 1 else 0 end), 6) as share, round(sum(sign(beta) * least(abs(t), {Z_CLIPPED})) / sqrt(count(*)), 4) as stouffer from irf join (select horizon, case when avg(case when beta > 0 then 1 else 0 end) >= avg(case when beta < 0 then 1 else 0 end) then 1 else -1 end as m from irf group by 1) using (horizon) group by 1",
        **IRF,
    )
)
def c04_curve_statistics(spark, sf):
    fits = small_irf(spark, sf).select("horizon", F.col("beta").alias("coef"), "p")
    return rounded(rounded(speccurve.statistics(fits, ["horizon"]), "median", "share", digits=6), "stouffer")


SHOCKS = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}


def spec_panel(spark: SparkSession, sf: str) -> DataFrame:
    """pos, y, ctrl, each priority's log index (null where it has none) and the tag of each year's first half."""
    wide = B.index(spark, sf).groupBy("date").pivot("series_id", list(SHOCKS.values())).agg(F.first(F.log1p("value")))
    rows = B.panel(spark, sf).select("date", (F.col("t") - 1).alias("pos"), "y", "ctrl").join(wide, "date", "left")
    return rows.select("pos", "y", "ctrl", (F.month("date") <= 6).alias("h1"), *(F.col(v).alias(k) for k, v in SHOCKS.items()))


def spec_grid(spark: SparkSession, forms: list[str]) -> DataFrame:
    """Every shock, with and without the control, on all days and on the first half of each year."""
    levels = speccurve.grid(spark, {"shock": list(SHOCKS), "controls": [["ctrl"], []], "funcform": forms, "sample": ["", "h1"]})
    name = F.concat_ws("/", "shock", F.concat_ws("+", "controls"), "funcform", "sample")
    return levels.select(name.alias("spec_id"), "shock", "controls", "funcform", F.nullif("sample", F.lit("")).alias("sample"))


SPEC_ROWS = "select t - 1 as pos, y, ctrl, month(date) <= 6 as h1, s.shock, ln(1 + value) as x from panel join idx using (date) join (values " + ", ".join(f"('{v}', '{k}')" for k, v in SHOCKS.items()) + ") s(series_id, shock) on s.series_id = idx.series_id"
SPEC_SETS = "select *, '' as sample from q union all select *, 'h1' from q where h1"
# Two regressors in closed form: sums of centred products of x, the control (left out where ctl = '') and the outcome.
SPEC_FITS = """select b, shock || '/' || ctl || '/ols/' || sample as spec_id, n, case when ctl = '' then xy / xx else (xy * cc - cy * xc) / (xx * cc - xc * xc) end as coef,
case when ctl = '' then sqrt((yy - xy * xy / xx) / (n - 2) / xx) else sqrt((yy - ((xy * cc - cy * xc) * xy + (cy * xx - xy * xc) * cy) / (xx * cc - xc * xc)) / (n - 3) * cc / (xx * cc - xc * xc)) end as se
from (select b, shock, sample, count(*) as n, var_pop(x) * count(*) as xx, var_pop(ctrl) * count(*) as cc, var_pop(yb) * count(*) as yy, covar_pop(x, ctrl) * count(*) as xc, covar_pop(x, yb) * count(*) as xy, covar_pop(ctrl, yb) * count(*) as cy from {rows} group by 1, 2, 3), (values (''), ('ctrl')) c(ctl)"""


@query(sql("idx panel", "select spec_id, round(coef, 6) as coef, round(se, 6) as se, n from f", q=SPEC_ROWS, r=SPEC_SETS, o="select *, -1 as b, y as yb from r", f=SPEC_FITS.format(rows="o")))
def c05_fit_specs(spark, sf):
    """The observed curve: rows of the grid drive the fits."""
    return rounded(speccurve.fit_specs(spec_panel(spark, sf), spec_grid(spark, ["ols"])).select("spec_id", "coef", "se", "n"), "coef", "se", digits=6)


@query(None)
def c05_quantile_specs(spark, sf):
    """The quantile branch of the grid; tests hold its fits against linear programs."""
    forms = [f"quantile {t}" for t in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return rounded(speccurve.fit_specs(spec_panel(spark, sf), spec_grid(spark, forms)).select("spec_id", "coef", "se", "n"), "coef", "se", digits=6)


@query(
    sql("idx panel", "")
    + f", {DRAW}, q as ({SPEC_ROWS}), r as ({SPEC_SETS}), moved as (select b, pos, y as yb from ix join (select t - 1 as source, y from panel) using (source)), d as (select b, r.*, yb from r join moved using (pos) union all select -1, r.*, y from r), f as ({SPEC_FITS.format(rows='d')}), g as (select *, coef / se as z from f), m as (select b, case when avg(case when coef > 0 then 1 else 0 end) >= avg(case when coef < 0 then 1 else 0 end) then 1 else -1 end as m from g group by 1), s as (select b, quantile_cont(coef, 0.5) as median, avg(case when abs(z) > {Z95} and sign(coef) = m then 1 else 0 end) as share, sum(sign(coef) * least(abs(z), {Z_CLIPPED})) / sqrt(count(*)) as stouffer from g join m using (b) group by 1) select round(o.median, 6) as median, round(o.share, 6) as share, round(o.stouffer, 4) as stouffer, round(avg(case when abs(s.median) >= abs(o.median) then 1 else 0 end), 6) as p_median, round(avg(case when s.share >= o.share then 1 else 0 end), 6) as p_share, round(avg(case when abs(s.stouffer) >= abs(o.stouffer) then 1 else 0 end), 6) as p_stouffer, count(*) as draws from s, (select * from s where b = -1) o where s.b >= 0 group by o.median, o.share, o.stouffer"
)
def c06_specification_curve(spark, sf):
    """Least-squares specifications of the grid, and null draws that move outcomes in blocks over all days of the panel."""
    fits = speccurve.fit_specs(spec_panel(spark, sf), spec_grid(spark, ["ols"]), BLOCK, DRAWS)
    return rounded(rounded(speccurve.curve(fits), "median", "share", "p_median", "p_share", "p_stouffer", digits=6), "stouffer")


@query(None)
def r07_sup_t_band(spark, sf):
    out = inference.sup_t(short_panel(spark, sf), ["panel_id"], "y", "x", ["ctrl"], range(4))
    return rounded(out.select("horizon", "beta", "se", "critical", "lo", "hi"), "beta", "se", "critical", "lo", "hi", digits=6)


def _cov_sql() -> str:
    """Pairwise sums of influence values with the HC1 factor."""
    scaled = "select horizon, t, psi * sqrt(n / (n - 3.0)) as psi from qp"
    return sql("panel", "select a.horizon as h, b.horizon as k, round(sum(a.psi * b.psi), 8) as cov from z a join z b using (t) where a.horizon >= b.horizon group by 1, 2", s=LEADS(range(4)), **Q.partial("s", ["horizon"], "yl", "x", ["ctrl"]), z=scaled)


@query(_cov_sql())
def j16_influence_pairs(spark, sf):
    """J16: the covariance of responses at two horizons, over the rows that both have."""
    psi = inference.scaled_influence(short_panel(spark, sf), ["panel_id"], "y", "x", ["ctrl"], range(4)).select("horizon", "t", "psi0")
    other = psi.select(F.col("horizon").alias("k"), "t", F.col("psi0").alias("other"))
    return psi.join(other, "t").where("horizon >= k").groupBy(F.col("horizon").alias("h"), "k").agg(R(F.sum(F.col("psi0") * F.col("other")), 8).alias("cov"))


@query(sql("panel", f"select horizon, round(b, 6) as beta, round(se, 6) as se from ({Q.hc1('q', ['horizon'], 6)})", s=LEADS(range(4)), **Q.partial("s", ["horizon"], "yl", "x", LAGGED)))
def r07_sup_t_errors(spark, sf):
    """Errors of the lag-augmented simultaneous band."""
    out = inference.sup_t(short_panel(spark, sf), ["panel_id"], "y", "x", ["ctrl"], range(4), "lag_augmented", 2, draws=100)
    return rounded(out.select("horizon", "beta", "se"), "beta", "se", digits=6)


@query(None)
def r08_quantile_projection(spark, sf):
    """Coefficients and errors; tests hold them against a linear program and committed values."""
    out = inference.quantile_projection(short_panel(spark, sf), ["panel_id"], "y", "x", ["ctrl"], range(3), 0.5)
    return rounded(out.select("horizon", "beta", "se", "t", "p", "nobs"), "beta", "se", "t", "p", digits=6)


@query(
    sql(
        "panel",
        "select sample, horizon, round(regr_slope(yl, x) * stddev_samp(x) / stddev_samp(yl), 6) as beta_std, regr_count(yl, x) as nobs from (select sample, h.horizon, shock / 1000 as x, lead(y, cast(h.horizon as int)) over (partition by sample, h.horizon order by t) as yl from panel join s on (first is null or date >= first) and (last is null or date <= last) cross join (values (0), (5)) h(horizon)) where yl is not null group by 1, 2",
        s=SAMPLES,
    )
)
def r12_by_sample(spark, sf):
    tagged = transforms.tag_samples(short_panel(spark, sf), samples(spark))
    stacked = timealign.leads(tagged, "y", [0, 5], ("sample",))
    fitted = gram.fit(stacked, ["sample", "horizon"], "y_lead", ["x"])
    spread = stacked.dropna(subset=["y_lead", "x"]).groupBy("sample", "horizon").agg(F.stddev_samp("x").alias("sx"), F.stddev_samp("y_lead").alias("sy"))
    out = fitted.join(spread, ["sample", "horizon"])
    return out.select("sample", "horizon", R(F.get("beta", F.lit(0)) * F.col("sx") / F.col("sy"), 6).alias("beta_std"), F.col("n").alias("nobs"))


ACTS = f"select cast(o_orderdate as date) as date, cast(sum(case when o_orderstatus <> 'O' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) / {B.UNIT * 1000} as act, cast(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) / {B.UNIT * 1000} as threat from orders group by 1"


def split_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily panel of the split index: panel_id, t, date, y, act, threat."""
    part = lambda c: F.sum(F.when(c, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double") / (B.UNIT * 1000)
    o = B.table(spark, sf, "orders").groupBy(B.day("o_orderdate")).agg(part(F.col("o_orderstatus") != "O").alias("act"), part(F.col("o_orderstatus") == "O").alias("threat"))
    both = o.join(B.market(spark, sf).select("date", F.log("price").alias("y")), "date").withColumn("panel_id", F.lit("daily"))
    return both.withColumn("t", F.row_number().over(Window.partitionBy("panel_id").orderBy("date")))


@query(
    sql(
        "mkt",
        "select horizon, round(regr_slope(yl, act), 6) as act, round(regr_slope(yl, threat), 6) as threat from (select h.horizon, act, threat, lead(ln(price), cast(h.horizon as int)) over (partition by h.horizon order by date) as yl from a join mkt using (date) cross join (values (0), (1), (2)) h(horizon)) where yl is not null group by 1",
        a=ACTS,
    )
)
def r13_threat_and_act(spark, sf):
    p = split_panel(spark, sf).unpivot(["panel_id", "t", "y"], ["act", "threat"], "kind", "x")
    irf = gram.local_projection(p, ["kind"], "y", "x", (), range(3))
    return rounded(irf.groupBy("horizon").pivot("kind", ["act", "threat"]).agg(F.first("beta")), "act", "threat", digits=6)


def _gap_sql() -> str:
    weighted = " + ".join(f"{1 - m / 6!r} * coalesce(l{m}, 0)" for m in range(1, 6))
    lagged = ", ".join(f"lag(d, {m}) over (order by t) as l{m}" for m in range(1, 6))
    body = f"select 'daily' as panel_id, round(max(g), 4) as gap, round(sqrt(sum(d * d) + 2 * sum(d * ({weighted}))), 4) as se, round(max(g) / sqrt(sum(d * d) + 2 * sum(d * ({weighted}))), 4) as z from (select *, {lagged} from d)"
    gap = "select t, a.psi - b.psi as d, (select b from qab) - (select b from qbb) as g from qap a join qbp b using (t)"
    panel = "select 'daily' as panel_id, row_number() over (order by date) as t, ln(price) as y, act, threat from a join mkt using (date)"
    return sql("mkt", body, a=ACTS, s=panel, **Q.partial("s", ["panel_id"], "y", "act", ["threat"], "qa"), **Q.partial("s", ["panel_id"], "y", "threat", ["act"], "qb"), d=gap)


@query(_gap_sql())
def p25_equal_terms(spark, sf):
    return rounded(inference.equal_terms(split_panel(spark, sf), ["panel_id"], "y", ["act", "threat"]).drop("p"), "gap", "se", "z")


def _split_sql() -> str:
    steps, parts = {}, []
    for name, x, other in (("qa", "level", "jump"), ("qb", "jump", "level")):
        steps |= Q.partial("s", ["horizon"], "yl", x, [other], name)
        parts.append(f"select horizon, '{x}' as term, round(b, 4) as beta, round(se, 4) as se, n as nobs from ({Q.hac(name, ['horizon'], 2)})")
    panel = "select j.value as level, jump, ln(price) as y, row_number() over (order by date) as t from j join mkt using (date)"
    stack = "select *, lead(y, cast(h.horizon as int)) over (partition by h.horizon order by t) as yl from rows0 cross join (values (0), (1), (2)) h(horizon)"
    lev = "select series_id, date, ln(1 + value) as value from gidx"
    return sql("gidx mkt", " union all ".join(parts), lev=lev, j=JUMPED.format(src="lev"), rows0=panel, s=stack, **steps)


@query(_split_sql())
def p16_channel_split(spark, sf):
    """Level and tail term of the index as two shocks of one projection."""
    g = B.global_index(spark, sf).withColumn("value", F.log1p("value"))
    rows = W.jump(g).select("date", F.col("value").alias("level"), "jump").join(B.market(spark, sf).select("date", F.log("price").alias("y")), "date")
    rows = rows.withColumn("panel_id", F.lit("daily")).withColumn("t", F.row_number().over(Window.partitionBy("panel_id").orderBy("date")))
    irf = gram.local_projection(rows, ["panel_id"], "y", "level", ["jump"], range(3), all_terms=True)
    return rounded(irf.select("horizon", "term", "beta", "se", "nobs"), "beta", "se")


@query(
    sql(
        "gidx ctry",
        "select round(regr_slope(x, g), 6) as beta, count(*) as n from (select x - avg(x) over (partition by series_id) as x, g - avg(g) over (partition by series_id) as g from (select series_id, ln(1 + value) as x, g from ctry join gm using (date)))",
        gm="select cast(date_trunc('month', date) as date) as date, avg(ln(1 + value)) as g from gidx group by 1",
    )
)
def p26_fixed_effects(spark, sf):
    g = B.global_index(spark, sf).groupBy(F.trunc("date", "MM").alias("date")).agg(F.avg(F.log1p("value")).alias("g"))
    c = B.countries(spark, sf).withColumn("x", F.log1p("value")).join(g, "date").withColumn("model", F.lit("all"))
    return inference.fixed_effects(c, ["model"], "series_id", "x", ["g"]).select(R(F.get("beta", F.lit(0)), 6).alias("beta"), "n")


@query(sql("idx mkt", "select series_id, k.lag, round(corr(x, v), 4) as corr, count(*) as n from (select series_id, k.lag, x, lead(y, cast(k.lag as int)) over (partition by series_id, k.lag order by date) as v from (select series_id, date, ln(1 + value) as x, ln(price) as y from idx join mkt using (date)) cross join (values (-2), (-1), (0), (1), (2)) k(lag)) k where v is not null group by 1, 2"))
def p22_lead_lag(spark, sf):
    i = B.index(spark, sf).join(B.market(spark, sf).select("date", F.log("price").alias("y")), "date").withColumn("x", F.log1p("value"))
    return rounded(inference.lead_lag(i, "x", "y", 2), "corr")


@query(
    sql(
        "idx mkt",
        "select channel, date, round(e, 6) as effect, round(abs(e) / sum(abs(e)) over (partition by date), 4) as share from (select series_id as channel, date, b * ln(1 + value) as e from idx join (select series_id, regr_slope(ln(price), ln(1 + value)) as b from idx join mkt using (date) group by 1) using (series_id))",
    )
)
def p23_contributions(spark, sf):
    i = B.index(spark, sf).select(F.col("series_id").alias("channel"), "date", F.log1p("value").alias("value"))
    y = B.market(spark, sf).select("date", F.log("price").alias("y"))
    theta = gram.fit(i.join(y, "date"), ["channel"], "y", ["value"]).select("channel", F.get("beta", F.lit(0)).alias("theta"))
    out = inference.contributions(i, theta).select("channel", "date", "effect", "share")
    return rounded(rounded(out, "effect", digits=6), "share")


PAIR = Q.partial("s", ["series_id", "horizon"], "yl", "dom", ["disc"], "qa") | Q.partial("s", ["series_id", "horizon"], "yl", "moved", ["disc"], "qb")
PAIR |= {"ra": Q.hac("qa", ["series_id", "horizon"], 2), "rb": Q.hac("qb", ["series_id", "horizon"], 2)}
PAIR |= {"v": f"select ra.series_id, ra.b < 0 and abs(ra.b / ra.se) > {Z90} and rb.b < 0 and abs(rb.b / rb.se) > {Z90} as shifted from ra join rb on ra.series_id = rb.series_id and ra.horizon = 2 and rb.horizon = 1"}


def replication_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The monthly response with the index in its own month, and in the month after."""
    p = country_panel(spark, sf)
    raw = gram.local_projection(p, ["series_id"], "price", "dom", ["disc"], range(3))
    moved = p.withColumn("dom", F.lag("dom").over(Window.partitionBy("series_id").orderBy("t")))
    return raw, gram.local_projection(moved, ["series_id"], "price", "dom", ["disc"], range(3))


@query(sql("gidx ctry mkt", "select series_id, shifted, horizon, panel, round(b, 4) as beta, round(se, 4) as se from v join (select *, 'raw' as panel from ra union all select *, 'aligned' from rb) using (series_id)", **COUNTRY, s=_country_leads("price", 3), **PAIR))
def r20_replication_pair(spark, sf):
    """J10, D17 and R20."""
    raw, aligned = replication_pair(spark, sf)
    both = raw.select("series_id", "horizon", F.lit("raw").alias("panel"), "beta", "se").unionByName(aligned.select("series_id", "horizon", F.lit("aligned").alias("panel"), "beta", "se"))
    return rounded(both.join(response.shifted(raw, aligned, ["series_id"]), "series_id"), "beta", "se")


@query(sql("gidx ctry mkt", "select series_id, shifted from v", **COUNTRY, s=_country_leads("price", 3), **PAIR))
def d17_shift_verdict(spark, sf):
    return response.shifted(*replication_pair(spark, sf), ["series_id"])
