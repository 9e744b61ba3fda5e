"""Indices and signals built from scored texts and statements, and how they are judged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def news_share(articles: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """100 * sum(score) / count for each grouping set of (period, ...) columns; columns out of a set are NULL."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    whole = articles.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in cols))
    return whole.agg((100 * F.try_divide(F.sum("score"), F.count("*"))).alias("index"), F.count("*").alias("n"))


def weighted_index(statements: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, index: weighted mean score; weights has one row per actor group (joined on `actor_group`), 1 where it has none."""
    joined = statements.join(weights, "actor_group", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)))
    return joined.groupBy(*keys).agg(F.try_divide(F.sum(F.col("w") * F.col("score")), F.sum("w")).alias("index"))


def source_balanced(articles: DataFrame, keys: Sequence[str], least: float = 0.5) -> DataFrame:
    """keys, index, coverage, complete: mean of the sources' own means; coverage is sources seen over all sources."""
    per = articles.groupBy(*keys, "source").agg(F.avg("score").alias("m"))
    every = articles.agg(F.count_distinct("source").alias("sources"))
    out = per.groupBy(*keys).agg(F.avg("m").alias("index"), F.count("*").alias("seen"))
    out = out.crossJoin(F.broadcast(every)).withColumn("coverage", F.try_divide("seen", "sources"))  # one row
    return out.select(*keys, "index", "coverage", (F.col("coverage") >= least).alias("complete"))


def keyword_filter(texts: DataFrame, words: Sequence[str], without: Sequence[str] = (), near: int = 10) -> DataFrame:
    """texts with hit (a keyword and no excluded word) and score: keyword pairs at most `near` words apart, per 100 words."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    bag = F.array(*map(F.lit, words))
    out = F.array(*map(F.lit, without)) if without else None
    found = texts.withColumn("_t", tokens)
    at = F.filter(F.transform("_t", lambda w, i: F.when(F.array_contains(bag, w), i)), lambda x: x.isNotNull())
    found = found.withColumns({"_at": at, "n_words": F.size("_t")})
    close = F.size(F.filter(F.zip_with(F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))), lambda b, a: b - a), lambda d: d <= near))
    hit = F.arrays_overlap("_t", bag) & (~F.arrays_overlap("_t", out) if out is not None else F.lit(True))
    return found.withColumns({"hit": hit, "score": F.try_divide(100.0 * close, "n_words")}).drop("_t", "_at")


def signed_index(statements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, escalation, conciliation, net, loudest: positive and negative weighted scores kept apart."""
    x = F.col("score") * F.coalesce("weight", F.lit(1.0))
    up, down = F.sum(F.when(x > 0, x).otherwise(0.0)), F.sum(F.when(x < 0, -x).otherwise(0.0))
    return statements.groupBy(*keys).agg(up.alias("escalation"), down.alias("conciliation"), (up - down).alias("net"), F.max(x).alias("loudest"))


def silence(df: DataFrame, by: str = "actor") -> DataFrame:
    """df with silent_days since the actor's previous day (NULL for the first)."""
    return df.withColumn("silent_days", F.datediff("date", F.lag("date").over(Window.partitionBy(by).orderBy("date"))))


def divergence(df: DataFrame, a: str, b: str, window: int = 60, least: int = 20, limit: float = 1.0) -> DataFrame:
    """df with gap = z(a) - z(b), each against its own past, and signal where |gap| exceeds the limit."""
    from .windows import over_past

    z = lambda c: F.try_divide(F.col(c) - over_past(F.avg, F.col(c), window, least), over_past(F.stddev_samp, F.col(c), window, least))
    return df.withColumn("gap", z(a) - z(b)).withColumn("signal", F.abs("gap") > limit)


def information_coefficient(df: DataFrame, signal: str, ret: str, horizons: Sequence[int], by: str = "series_id") -> DataFrame:
    """(by, horizon, ic, rank_ic, hit): correlation of the signal with the return h rows later, by value and by rank."""
    w = Window.partitionBy(by).orderBy("date")
    later = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead(ret, h).over(w).alias("later")) for h in horizons))
    long = df.select(by, signal, later.alias("e")).withColumn("e", F.explode("e")).select(by, signal, "e.horizon", "e.later").dropna()
    v = lambda c: Window.partitionBy(by, "horizon").orderBy(c)
    long = long.withColumns({"rs": F.rank().over(v(signal)), "rl": F.rank().over(v("later"))})
    return long.groupBy(by, "horizon").agg(F.corr(signal, "later").alias("ic"), F.corr("rs", "rl").alias("rank_ic"), F.avg((F.signum(signal) == F.signum("later")).cast("int")).alias("hit"))


def folds(spark, first: str, last: str, train_years: int = 3, test_years: int = 1, step_months: int = 12, purge: int = 10) -> DataFrame:
    """(fold, train_first, train_last, test_first, test_last): walk-forward folds; training ends `purge` days before the test."""
    starts = spark.sql(f"select posexplode(sequence(date '{first}', add_months(date '{last}', {-12 * (train_years + test_years)}), interval {step_months} months)) as (fold, train_first)")
    out = starts.withColumn("test_first", F.add_months("train_first", 12 * train_years))
    return out.select("fold", "train_first", F.date_sub("test_first", purge + 1).alias("train_last"), "test_first", F.date_sub(F.add_months("test_first", 12 * test_years), 1).alias("test_last"))


def tag_folds(df: DataFrame, made: DataFrame) -> DataFrame:
    """df with fold and part ('train' or 'test'); purged days belong to neither."""
    d = F.col("date")
    part = F.when(d.between(F.col("train_first"), F.col("train_last")), "train").when(d.between(F.col("test_first"), F.col("test_last")), "test")
    return df.join(F.broadcast(made), d.between(F.col("train_first"), F.col("test_last"))).withColumn("part", part).where("part is not null").select(*df.columns, "fold", "part")


def backtest(df: DataFrame, position: Column, cost: float = 0.0005, by: str = "series_id") -> DataFrame:
    """(by, days, total, sharpe, drawdown, turnover) of holding yesterday's position: log-compounded, cost per unit turned."""
    w = Window.partitionBy(by).orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("p", position).withColumn("held", F.coalesce(F.lag("p").over(w), F.lit(0.0)))
    held = held.withColumn("turn", F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))))
    gain = held.where("ret is not null").withColumn("net", F.col("held") * F.col("ret") - cost * F.col("turn"))
    wealth = gain.withColumn("log_wealth", F.sum(F.log1p("net")).over(upto)).withColumn("top", F.greatest(F.max("log_wealth").over(upto), F.lit(0.0)))
    sharpe = F.try_divide(F.avg("net") * F.sqrt(F.lit(252.0)), F.stddev_samp("net"))
    return wealth.groupBy(by).agg(F.count("*").alias("days"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("total"), sharpe.alias("sharpe"), F.min(F.exp(F.col("log_wealth") - F.col("top")) - 1).alias("drawdown"), F.sum("turn").alias("turnover"))


def holm(tests: DataFrame, group: str) -> DataFrame:
    """tests (group, name, p) with p_holm: the step-down adjustment within each group."""
    by = Window.partitionBy(group)
    order = by.orderBy("p", "name")
    step = tests.withColumn("_a", (F.count("*").over(by) - F.row_number().over(order) + 1) * F.col("p"))
    return step.withColumn("p_holm", F.least(F.lit(1.0), F.max("_a").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_a")


def pinball(actual: Column, quantile: Column, tau: float) -> Column:
    return F.when(actual >= quantile, tau * (actual - quantile)).otherwise((1 - tau) * (quantile - actual))


def forecast_scores(df: DataFrame, chance: str, happened: str, actual: str, quantiles: dict[float, str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """keys, n, brier, crps: the mean squared error of a forecast chance against what happened, and the continuous ranked
    probability score as twice the mean pinball loss over the forecast quantiles (tau: column). Rows without a forecast or an
    outcome are left out."""
    whole = df.dropna(subset=[chance, happened, actual, *quantiles.values()])
    loss = sum((pinball(F.col(actual), F.col(c), tau) for tau, c in quantiles.items()), F.lit(0.0)) * 2 / len(quantiles)
    off = F.col(chance) - F.col(happened).cast("double")
    return whole.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(off * off).alias("brier"), F.avg(loss).alias("crps"))


def correlation(a: str, b: str) -> Column:
    """An aggregate: Pearson's correlation, NULL where one side doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def ordinal_agreement(ratings: DataFrame) -> DataFrame:
    """One row alpha: Krippendorff's alpha for ordinal ratings (unit, rating: a number), from the margins of the coincidences.

    The distance of two ratings is the square of the ratings' share between them, half of both ends' included, so it is a
    difference of running sums, and within a unit only ratings that occur there meet.
    """
    per = ratings.where("rating is not null").groupBy("unit", "rating").agg(F.count("*").alias("c"))
    per = per.withColumn("m", F.sum("c").over(Window.partitionBy("unit"))).where("m > 1")
    margin = per.groupBy("rating").agg(F.sum("c").cast("double").alias("k"))
    place = margin.withColumn("at", F.sum("k").over(Window.orderBy("rating")) - F.col("k") / 2)  # one row a rating
    rated = per.join(F.broadcast(place.select("rating", "at")), "rating")
    # Sum of squared differences over all pairs of a group: 2 (n sum x^2 - (sum x)^2).
    unit = rated.groupBy("unit").agg((2 * (F.sum("c") * F.sum(F.col("c") * F.col("at") * F.col("at")) - F.pow(F.sum(F.col("c") * F.col("at")), F.lit(2.0))) / (F.first("m") - 1)).alias("d"))
    seen = unit.agg(F.sum("d").alias("seen"))
    total = place.agg((2 * (F.sum("k") * F.sum(F.col("k") * F.col("at") * F.col("at")) - F.pow(F.sum(F.col("k") * F.col("at")), F.lit(2.0))) / (F.sum("k") - 1)).alias("chance"))
    return seen.crossJoin(total).select((1 - F.try_divide("seen", "chance")).alias("alpha"))  # one row each


def agreement(ratings: DataFrame) -> DataFrame:
    """One row alpha: Krippendorff's alpha for nominal ratings (unit, rating), from coincidence counts."""
    per = ratings.groupBy("unit", "rating").agg(F.count("*").alias("c"))
    per = per.withColumn("m", F.sum("c").over(Window.partitionBy("unit"))).where("m > 1")
    same = per.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"), F.sum("c").cast("double").alias("n"))
    chance = per.groupBy("rating").agg(F.sum("c").cast("double").alias("k")).agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("pairs"))
    expected = F.col("pairs") / (F.col("n") - 1)
    return same.crossJoin(chance).select((1 - F.try_divide(F.col("n") - F.col("same"), F.col("n") - expected)).alias("alpha"))  # one row each


BLOCK, CHUNK = 8192, 2048  # vectors and queries of one task's matrix product, about


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, blocks: int = 64) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest vectors of every query by cosine, exactly. Neighbours with
    conditions, such as a distance in time, are those of `analogues.nearest`.

    The stated query set meets all rows in blocks, `blocks` of them or as many as keep a block near BLOCK rows, and in chunks
    of about CHUNK queries: each chunk is copied to each block, a block keeps its own best k per query by matrix product, and
    only those are compared across blocks. So a task's memory doesn't grow with the table.
    """
    import numpy as np
    import pandas as pd

    blocks, chunks = max(blocks, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // CHUNK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), each(chunks).alias("chunk"), "vec_id", "embedding")
    q = queries.select(F.col("vec_id").alias("query_id"), "embedding", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).cast("int").alias("chunk"), each(blocks).alias("block"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "cosine": []})
        unit = lambda x: (m := np.stack(x.to_numpy()).astype(np.float64)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        score = unit(right["embedding"]) @ unit(left["embedding"]).T
        score[right["query_id"].to_numpy()[:, None] == left["vec_id"].to_numpy()[None, :]] = -2
        ids = left["vec_id"].to_numpy()
        out = []
        for i, row in enumerate(score):
            top = np.lexsort((ids, -row))[:k]
            out.append(pd.DataFrame({"query_id": right["query_id"].iloc[i], "vec_id": ids[top], "cosine": row[top]}))
        return pd.concat(out)

    near = v.groupBy("block", "chunk").cogroup(q.groupBy("block", "chunk")).applyInPandas(best, "query_id long, vec_id long, cosine double").where("cosine > -2")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
