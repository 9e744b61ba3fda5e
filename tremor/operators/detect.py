"""Detection quality of shock measures: salience at events, AUC with intervals, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def salience(rows: DataFrame, events: DataFrame, keys: Sequence[str] = ("measure", "sample")) -> DataFrame:
    """keys, mean_z, hit, n: at event dates the mean of value / sigma, and the share above 2 sigma."""
    sigma = rows.groupBy(*keys).agg(F.stddev_samp("value").alias("sigma"))
    at = rows.where("value is not null").join(events.select(F.col("event_date").alias("date")).distinct(), "date")
    z = F.try_divide("value", "sigma")
    return at.join(sigma, list(keys)).groupBy(*keys).agg(F.avg(z).alias("mean_z"), F.avg((z > 2).cast("int")).alias("hit"), F.count("*").alias("n"))


def verdict(table: DataFrame, by: str = "sample", what: str = "measure", within: Sequence[str] = ()) -> DataFrame:
    """(within, sample, winner, stable): the best measure by hit rate, then mean z; stable if the same one wins in all samples
    of its group."""
    w = Window.partitionBy(*within, by).orderBy(F.desc_nulls_last("hit"), F.desc_nulls_last("mean_z"), what)
    first = table.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(*within, by, F.col(what).alias("winner"))
    same = first.groupBy(*within).agg((F.count_distinct("winner") == 1).alias("stable"))
    return first.join(same, list(within)) if within else first.crossJoin(F.broadcast(same))  # one row


def auc(rows: DataFrame, keys: Sequence[str] = ("measure", "sample"), weight: str | None = None, least: int = 3) -> DataFrame:
    """keys, auc, n_event, n_control: Mann-Whitney with mid-ranks over (value, is_event); NULL below `least` on a side.

    Counts per distinct value, then one running sum over the values of a model: no pairs.
    """
    one = F.col(weight) if weight else F.lit(1)
    side = lambda e: F.sum(F.when(F.col("is_event") == e, one).otherwise(0))
    per = rows.where("value is not null").groupBy(*keys, "value").agg(side(True).alias("e"), side(False).alias("c"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = per.withColumn("below", below).groupBy(*keys).agg(F.sum(F.col("e") * (F.col("below") + F.col("c") / 2)).alias("u"), F.sum("e").alias("n_event"), F.sum("c").alias("n_control"))
    enough = (F.col("n_event") >= least) & (F.col("n_control") >= least)
    return u.select(*keys, F.when(enough, F.try_divide(F.col("u"), F.col("n_event") * F.col("n_control"))).alias("auc"), "n_event", "n_control")


def draw(seed: int, *parts, below):
    """A portable whole number in [0, below): a multiplicative hash of whole-number columns that any SQL engine can repeat."""
    x = F.lit(seed % 1000003).cast("long")
    for p in parts:
        x = (x * 7919 + p * 104729 + 12345) % 1000003
        x = (x * x + x * 31 + 7) % 1000003
    return x % below


def auc_by_years(dated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y1, y2, u: the Mann-Whitney count of the events of one year against the controls of another (ties: a half)."""
    per = dated.groupBy(*keys, "year", "value").agg(F.count_if("is_event").alias("e"), F.count_if(~F.col("is_event")).alias("c"))
    years = dated.select(*keys, F.col("year").alias("y2")).distinct()
    asked = per.where("e > 0").join(years, list(keys)).select(*keys, "y2", "value", F.col("year").alias("y1"), "e", F.lit(0).cast("long").alias("c"))
    held = per.where("c > 0").select(*keys, F.col("year").alias("y2"), "value", F.lit(None).cast("int").alias("y1"), F.lit(0).cast("long").alias("e"), "c")
    w = Window.partitionBy(*keys, "y2").orderBy("value")
    same, upto = F.sum("c").over(Window.partitionBy(*keys, "y2", "value")), F.sum("c").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return asked.unionByName(held).withColumn("under", upto - same / 2).where("y1 is not null").groupBy(*keys, "y1", "y2").agg(F.sum(F.col("e") * F.col("under")).alias("u"))


def auc_interval(rows: DataFrame, keys: Sequence[str] = ("measure", "sample"), draws: int = 2000, seed: int = 1, level: float = 0.95, least: int = 3) -> DataFrame:
    """keys, lo, hi: percentile interval of the AUC when calendar years are drawn with replacement.

    A draw is a multiplicity for each year, and its AUC a quadratic form of these over the counts of `auc_by_years`; so rows are
    read once, however many draws there are.
    """
    keys = list(keys)
    dated = rows.withColumn("year", F.year("date"))
    years = dated.select(*keys, "year").distinct().withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("year")) - 1)
    years = years.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    known = dated.where("value is not null")
    sides = known.groupBy(*keys, "year").agg(F.count_if("is_event").alias("e"), F.count_if(~F.col("is_event")).alias("c"))
    picks = years.select(*keys, "n", F.col("nth").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    picks = picks.withColumn("nth", draw(seed, F.col("b"), F.col("k"), below=F.col("n"))).groupBy(*keys, "b", "nth").agg(F.count("*").alias("weight"))
    picks = picks.join(years.drop("n"), [*keys, "nth"]).drop("nth")
    total = picks.join(sides, [*keys, "year"]).groupBy(*keys, "b").agg(F.sum(F.col("weight") * F.col("e")).alias("e"), F.sum(F.col("weight") * F.col("c")).alias("c"))
    first, second = (picks.select(*keys, "b", F.col("year").alias(y), F.col("weight").alias(w)) for y, w in (("y1", "w1"), ("y2", "w2")))
    both = auc_by_years(known, keys).join(first, [*keys, "y1"]).join(second, [*keys, "b", "y2"]).groupBy(*keys, "b").agg(F.sum(F.col("w1") * F.col("w2") * F.col("u")).alias("u"))
    each = total.join(both, [*keys, "b"], "left").select(*keys, F.when((F.col("e") >= least) & (F.col("c") >= least), F.coalesce("u", F.lit(0.0)) / (F.col("e") * F.col("c"))).alias("auc"))
    a = (1 - level) / 2
    return each.groupBy(*keys).agg(F.percentile("auc", F.lit(a)).alias("lo"), F.percentile("auc", F.lit(1 - a)).alias("hi"), F.count("auc").alias("n_draws"))


def rank_by(table: DataFrame, value: str, by: str | Sequence[str] = "sample", what: str = "measure") -> DataFrame:
    """table with rank: largest value first, nulls last, ties by name."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(value), what)))


def percent_below(rows: DataFrame, marks: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """keys, mark, pct: share (in percent) of a series strictly below each of its marks. Counts over a sorted union, no pairs."""
    both = rows.where("value is not null").select(*keys, "value", F.lit(1).alias("own")).unionByName(marks.select(*keys, F.col("mark").alias("value"), F.lit(0).alias("own")))
    w = Window.partitionBy(*keys).orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per = both.groupBy(*keys, "value").agg(F.sum("own").alias("own"), F.max(F.col("own") == 0).alias("asked"))
    per = per.withColumns({"upto": F.sum("own").over(w), "n": F.sum("own").over(Window.partitionBy(*keys))})
    return per.where("asked").select(*keys, F.col("value").alias("mark"), F.try_divide(100.0 * (F.col("upto") - F.col("own")), F.col("n")).alias("pct"))


def peak_report(rows: DataFrame, first: str, last: str, pre_first: str, pre_last: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """keys, peak, peak_date, pre_mean, ratio: the peak in a window against the mean of an earlier one."""
    inside, before = F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.col("date").between(F.lit(pre_first).cast("date"), F.lit(pre_last).cast("date"))
    out = rows.groupBy(*keys).agg(F.max(F.when(inside, F.col("value"))).alias("peak"), F.max_by("date", F.when(inside, F.struct("value", -F.datediff("date", F.lit("1970-01-01"))))).alias("peak_date"), F.avg(F.when(before, F.col("value"))).alias("pre_mean"))
    return out.withColumn("ratio", F.try_divide("peak", "pre_mean"))


def claimed_numbers(texts: DataFrame, payload: DataFrame, allowed: Sequence[str] = ("0", "1", "100"), id_col: str = "doc_id") -> DataFrame:
    """(id, number): numbers in texts (id, text) that payload (value) doesn't hold as such, times 100, or as a rounded percentage.

    Dates, long hexadecimal marks and references like `E12` are taken out first.
    """
    plain = F.col("text")
    for pattern in (r"\d{4}-\d{2}-\d{2}", r"\b[0-9a-f]{8,}\b", r"\b[A-Za-z]+\d+\b"):
        plain = F.regexp_replace(plain, pattern, " ")
    said = texts.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))).alias("number"))
    said = said.where(~F.col("number").isin(*allowed)).withColumn("key", F.round(F.col("number").cast("double"), 4))
    held = payload.select(F.explode(F.array(F.round("value", 4), F.round(F.col("value") * 100, 4), F.round(F.col("value") * 100, 0))).alias("key")).distinct()
    return said.join(held, "key", "left_anti").select(id_col, "number")
