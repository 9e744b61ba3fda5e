"""The driver's tables as the library's inputs, in Spark and as SQL.

Money is summed as decimals, so that both engines start from equal doubles, and divided by the prime UNIT, so that no mean
of it falls on the edge where a result is rounded. R rounds a result to four digits.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 997

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def R(c: str | Column, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: R(c, digits) for c in columns})


def day(c: str) -> Column:
    return F.col(c).cast("date").alias("date")


def index(spark: SparkSession, sf: str) -> DataFrame:
    """Daily index of each priority: (series_id, date, value)."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), day("o_orderdate")).agg((money("o_totalprice") / UNIT).alias("value"))


def global_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(day("o_orderdate")).agg((money("o_totalprice") / UNIT).alias("value")).select(F.lit("GLOBAL").alias("series_id"), "date", "value")


def market(spark: SparkSession, sf: str) -> DataFrame:
    """Daily market: date, price, qty, disc, tax."""
    n = F.count("*")
    return table(spark, sf, "lineitem").groupBy(day("l_shipdate")).agg((money("l_extendedprice") / UNIT / n).alias("price"), F.sum("l_quantity").alias("qty"), (money("l_discount") * 1000 / UNIT / n).alias("disc"), (money("l_tax") * 1000 / UNIT / n).alias("tax"))


def market_long(spark: SparkSession, sf: str) -> DataFrame:
    return market(spark, sf).unpivot(["date"], ["price", "qty", "disc", "tax"], "series_id", "value")


def countries(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly index of each nation: (series_id, date, value)."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations at any scale
    return joined.groupBy(F.col("n_name").alias("series_id"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("date")).agg((money("o_totalprice") / UNIT).alias("value"))


def days(spark: SparkSession, sf: str) -> DataFrame:
    """Decision days: weekdays on which something shipped."""
    return table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("decision_day")).where(F.weekday("decision_day") < 5).distinct()


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Exogenous events: dates of the three largest orders of each year."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    w = Window.partitionBy(F.year("date")).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("_n", F.row_number().over(w)).where("_n <= 3").select(F.col("date").alias("event_date")).distinct()


_MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"
CTE = {
    "idx": f"select o_orderpriority as series_id, cast(o_orderdate as date) as date, {_MONEY.format('o_totalprice')} / {UNIT} as value from orders group by 1, 2",
    "gidx": f"select 'GLOBAL' as series_id, cast(o_orderdate as date) as date, {_MONEY.format('o_totalprice')} / {UNIT} as value from orders group by 2",
    "mkt": f"select cast(l_shipdate as date) as date, {_MONEY.format('l_extendedprice')} / {UNIT} / count(*) as price, sum(l_quantity) as qty, {_MONEY.format('l_discount')} * 1000 / {UNIT} / count(*) as disc, {_MONEY.format('l_tax')} * 1000 / {UNIT} / count(*) as tax from lineitem group by 1",
    "mktl": "select date, series_id, value from (unpivot mkt on price, qty, disc, tax into name series_id value value)",
    "ctry": f"select n_name as series_id, cast(date_trunc('month', o_orderdate) as date) as date, {_MONEY.format('o_totalprice')} / {UNIT} as value from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
    "days": "select distinct cast(l_shipdate as date) as decision_day from lineitem where isodow(l_shipdate) < 6",
    "ev": "select distinct date as event_date from (select cast(o_orderdate as date) as date, row_number() over (partition by year(o_orderdate) order by o_totalprice desc, o_orderkey) as n from orders) where n <= 3",
    "prev": "select decision_day, coalesce(lag(decision_day) over (order by decision_day), decision_day - case isodow(decision_day) when 1 then 3 when 7 then 2 else 1 end) as prev from days",
    "panel": "select row_number() over (order by date) as t, date, x.value as shock, ln(price) as y, disc as ctrl, ln(qty) as y2 from gidx x join mkt using (date)",
}
_NEEDS = {"mktl": ("mkt",), "prev": ("days",), "panel": ("gidx", "mkt")}


def sql(names: str, body: str, **more: str) -> str:
    """A query over named inputs (and more, in order)."""
    todo: list[str] = []
    for name in names.split():
        for x in (*_NEEDS.get(name, ()), name):
            if x not in todo:
                todo.append(x)
    parts = [f"{x} as ({CTE[x]})" for x in todo] + [f"{k} as ({v})" for k, v in more.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """One daily panel: panel_id, t (dense), date, shock, y, ctrl, y2."""
    from pyspark.sql import Window

    both = global_index(spark, sf).drop("series_id").join(market(spark, sf), "date")
    rows = both.select(F.lit("daily").alias("panel_id"), "date", F.col("value").alias("shock"), F.log("price").alias("y"), F.col("disc").alias("ctrl"), F.log("qty").alias("y2"))
    return rows.withColumn("t", F.row_number().over(Window.partitionBy("panel_id").orderBy("date")))


def names(*pairs: tuple[str, Query]) -> dict[str, Query]:
    return dict(pairs)


def wide_sql(ids: Sequence[str]) -> str:
    return ", ".join(f"max(case when series_id = '{x}' then value end) as \"{x}\"" for x in ids)
