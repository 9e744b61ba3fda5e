"""Past-only rolling and expanding measures of series (series_id, date, value): jumps, episodes, expanding regressions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import transforms



def ordered():
    """Each series in time order."""
    return Window.partitionBy("series_id").orderBy("date")


def past(rows: int | None = None):
    """The window of the last `rows` rows before this one (all of them without a number)."""
    return ordered().rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def over_past(f, x: Column, rows: int | None, least: int) -> Column:
    """An aggregate over past rows, where at least `least` of them have a value."""
    return F.when(F.count(x).over(past(rows)) >= least, f(x).over(past(rows)))


def quantile(q: float):
    return lambda x: F.percentile(x, F.lit(q))


def lags(df: DataFrame, columns: Sequence[str], order: int) -> DataFrame:
    """df with <column>_l1 .. _l<order>."""
    return df.withColumns({f"{c}_l{k}": F.lag(c, k).over(ordered()) for c in columns for k in range(1, order + 1)})


def jump(df: DataFrame, window: int = 250, q: float = 0.95, least: int | None = None) -> DataFrame:
    """df with z (against the past window) and jump = max(0, z - past quantile of z); NULL while warming up or at zero spread."""
    least = max(20, window // 4) if least is None else least
    x = F.col("value")
    df = df.withColumn("z", F.try_divide(x - over_past(F.avg, x, window, least), over_past(F.stddev_samp, x, window, least)))
    over = F.col("z") - over_past(quantile(q), F.col("z"), window, least)
    return df.withColumn("jump", F.when(over.isNotNull(), F.greatest(over, F.lit(0.0))))


def exceedances(df: DataFrame, window: int = 250, q: float = 0.975, least: int | None = None) -> DataFrame:
    """Rows above the past quantile."""
    limit = over_past(quantile(q), F.col("value"), window, window if least is None else least)
    return df.withColumn("limit", limit).where("value > limit")


def episodes(hits: DataFrame, gap: int = 10) -> DataFrame:
    """hits with episode and first: a hit more than `gap` days after the previous hit begins a new episode."""
    new = F.coalesce((F.datediff("date", F.lag("date").over(ordered())) > gap).cast("int"), F.lit(1))
    return hits.withColumn("first", new == 1).withColumn("episode", F.sum(new).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def expanding_fit(df: DataFrame, y: str, xs: Sequence[str], least: int, out: str = "forecast", by: Sequence[str] = ("series_id",), order: str = "date") -> DataFrame:
    """df with the one-step forecast of y from xs by least squares (with intercept) on earlier rows only.

    Running sums of products over the past rows give each row's normal equations; a vectorised function solves them. Rows
    with a null among y and xs take no part in a fit. NULL before `least` complete rows; minimum norm when singular.
    """
    full = F.lit(True)
    for c in (y, *xs):
        full = full & F.col(c).isNotNull()
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shift = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # Values less the series' first complete row: a fixed shift that keeps the sums small and looks at the past only.
    zero = {c: F.first(F.when(full, F.col(c)), ignorenulls=True).over(shift) for c in (y, *xs)}
    cells = {c: F.col(c) - zero[c] for c in (y, *xs)}
    k = len(xs)
    names = [F.lit(1.0), *(cells[c] for c in xs)]
    sums = [F.sum(F.when(full, names[i] * names[j])).over(w) for i in range(k + 1) for j in range(i + 1)]
    rhs = [F.sum(F.when(full, names[i] * cells[y])).over(w) for i in range(k + 1)]

    @F.pandas_udf("double")
    def solve(gram: pd.Series, target: pd.Series, here: pd.Series) -> pd.Series:
        result = np.full(len(gram), np.nan)
        ok = np.array([g is not None and h is not None and not any(v is None or v != v for v in (*g, *h)) for g, h in zip(gram, here, strict=True)], bool)
        if ok.any():
            low = np.array([*gram[ok]], float)
            a = np.zeros((len(low), k + 1, k + 1))
            i, j = np.tril_indices(k + 1)
            a[:, i, j] = a[:, j, i] = low
            b, x = np.array([*target[ok]], float), np.array([*here[ok]], float)
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            unit = a / scale[:, :, None] / scale[:, None, :]
            coef = np.einsum("nij,nj->ni", np.linalg.pinv(unit, rcond=1e-13, hermitian=True), b / scale) / scale
            result[ok] = (coef[:, 0] + (coef[:, 1:] * x).sum(1)) if k else coef[:, 0]
        return pd.Series(result).where(~np.isnan(result), None)

    ready = F.when(F.sum(full.cast("int")).over(w) >= least, F.array(*sums))
    here = F.array(*(cells[c] for c in xs)) if xs else F.array(F.lit(0.0))
    df = df.withColumns({"_gram": ready, "_rhs": F.array(*rhs), "_here": here, "_zero": zero[y]})
    guess = solve("_gram", "_rhs", "_here")
    return df.withColumn(out, F.when(F.col("_gram").isNotNull(), guess + F.col("_zero"))).drop("_gram", "_rhs", "_here", "_zero")


def persistent(df: DataFrame, order: int, least: int = 60) -> DataFrame:
    """df (non-null rows) with `persistent`, the expanding AR(order) forecast of value; order 0 is the past mean.

    Warm-up is max(least, order + 2) values, of which the fit uses those with all lags.
    """
    warm = max(least, order + 2)
    dense = df.where("value is not null")
    if not order:
        return dense.withColumn("persistent", over_past(F.avg, F.col("value"), None, warm))
    lagged = lags(dense, ["value"], order)
    return expanding_fit(lagged, "value", [f"value_l{k}" for k in range(1, order + 1)], warm - order, "persistent").drop(*(f"value_l{k}" for k in range(1, order + 1)))


def innovation(df: DataFrame, order: int, least: int = 60) -> DataFrame:
    """df with persistent and innovation = value - persistent."""
    return persistent(df, order, least).withColumn("innovation", F.col("value") - F.col("persistent"))


def shock_transform(df: DataFrame, method: str = "innovation", order: int = 1, least: int = 60) -> DataFrame:
    """(series_id, date, value) with each series as shocks: `innovation` of the log level, `zscore` or `log1p` (both levels, for
    control). Any other method is an error."""
    if method == "innovation":
        shocks = innovation(df.withColumn("value", transforms.log1p(F.col("value"))), order, least).withColumn("value", F.col("innovation"))
    elif method in ("zscore", "log1p"):
        shocks = df.withColumn("value", getattr(transforms, method)(F.col("value")))
    else:
        raise ValueError(f"no shock transform {method!r}")
    return shocks.select("series_id", "date", "value")


def surprise(df: DataFrame, acts: str = "acts", threats: str = "threats", k: int = 5, least: int = 120) -> DataFrame:
    """df with surprise: acts less their expanding forecast from k lags of acts and threats."""
    lagged = lags(df.dropna(subset=[acts, threats]), [acts, threats], k)
    names = [f"{c}_l{j}" for c in (acts, threats) for j in range(1, k + 1)]
    return expanding_fit(lagged, acts, names, max(least, 2 * k + 3), "expected").withColumn("surprise", F.col(acts) - F.col("expected")).drop(*names)


def shock_suite(df: DataFrame, order: int = 1, least: int = 60, window: int = 250, q: float = 0.95) -> DataFrame:
    """Long (series_id, date, measure, value): LEVEL, PERSISTENT, INNOV, JUMP, LEVEL_PLUS_JUMP of each series."""
    level = df.where("value > -1").withColumn("value", F.log1p("value"))
    parts = jump(innovation(level, order, least), window, q)
    return parts.select(
        "series_id", "date", F.col("value").alias("LEVEL"), F.col("persistent").alias("PERSISTENT"), F.col("innovation").alias("INNOV"), F.col("jump").alias("JUMP"), (F.col("value") + F.col("jump")).alias("LEVEL_PLUS_JUMP")
    ).unpivot(["series_id", "date"], ["LEVEL", "PERSISTENT", "INNOV", "JUMP", "LEVEL_PLUS_JUMP"], "measure", "value")


def percent_rank_year(df: DataFrame, days: int = 365) -> DataFrame:
    """df with pct_rank: share of the non-null values of the last `days` days (this one included) that aren't larger; NULL for a
    null value.

    Each calendar year of a series is one sorted pass with the rows of the year before as its beginning, so a task never holds
    more than two years of a series; the values in the window are kept sorted, and a row is a binary search.
    """
    if not 0 < days <= 365:
        raise ValueError("the window is a year at most")
    year = F.year("date")
    rows = df.withColumns({"_year": F.explode(F.array(year, year + 1)), "_day": F.datediff("date", F.lit("1970-01-01"))}).withColumn("_own", F.col("_year") == year)
    dealt = rows.repartition("series_id", "_year").sortWithinPartitions("series_id", "_year", "_day")
    names, kinds = df.columns, df.dtypes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, known, inside = None, [], deque()

        def ranked(part: pd.DataFrame) -> pd.DataFrame:
            """Whole days of rows: a day's values all come into the window before its ranks are taken."""
            nonlocal group, known, inside
            keys = list(zip(part["series_id"], part["_year"], part["_day"], strict=True))
            values, own = part["value"].tolist(), part["_own"].tolist()
            ranks, k = [], 0
            while k < len(keys):
                end = k
                while end < len(keys) and keys[end] == keys[k]:
                    end += 1
                s, y, d = keys[k]
                if group != (s, y):
                    group, known, inside = (s, y), [], deque()
                while inside and inside[0][0] < d - days:
                    del known[bisect_left(known, inside.popleft()[1])]
                there = [v is not None and v == v for v in values[k:end]]
                for v, ok in zip(values[k:end], there, strict=True):
                    if ok:
                        insort(known, v)
                        inside.append((d, v))
                ranks += [bisect_right(known, v) / len(known) if ok and mine else None for v, ok, mine in zip(values[k:end], there, own[k:end], strict=True)]
                k = end
            return part[names].assign(pct_rank=ranks)[part["_own"]]

        left = None
        for part in parts:
            part = part if left is None else pd.concat([left, part], ignore_index=True)
            last = part.iloc[-1] if len(part) else None
            open_day = (part["series_id"] == last["series_id"]) & (part["_year"] == last["_year"]) & (part["_day"] == last["_day"]) if len(part) else None
            if open_day is None:
                continue
            left = part[open_day]
            yield ranked(part[~open_day])
        if left is not None:
            yield ranked(left)

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds), "pct_rank double"])
    return dealt.mapInPandas(run, schema)


def state_runs(df: DataFrame, state: str = "state") -> DataFrame:
    """df with run (its number) and days_in_state: gaps and islands over date."""
    new = F.coalesce((F.col(state) != F.lag(state).over(ordered())).cast("int"), F.lit(1))
    df = df.withColumn("run", F.sum(new).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("days_in_state", F.datediff("date", F.min("date").over(Window.partitionBy("series_id", "run"))) + 1)


def ladder(df: DataFrame, words: str, threats: str, acts: str, window: int = 250, least: int = 60) -> DataFrame:
    """df with state S0 .. S4 and days_in_state: words, threats and acts against their own past percentiles.

    S4: acts above p90; S3: acts above p75; S2: words and threats above p75; S1: words above p75; else S0.
    """
    over = lambda c, q: F.coalesce(F.col(c) > over_past(quantile(q), F.col(c), window, least), F.lit(False))
    flags = df.withColumns({"_a9": over(acts, 0.9), "_a7": over(acts, 0.75), "_t7": over(threats, 0.75), "_w7": over(words, 0.75)})
    state = F.when(F.col("_a9"), "S4").when(F.col("_a7"), "S3").when(F.col("_w7") & F.col("_t7"), "S2").when(F.col("_w7"), "S1").otherwise("S0")
    return state_runs(flags.withColumn("state", state).drop("_a9", "_a7", "_t7", "_w7"))


def full_surprise(df: DataFrame, acts: str, threats: str, words: str, k: int = 2, least: int = 120) -> DataFrame:
    """df with surprise: acts less their expanding forecast from lags of threats and words and the last ladder step."""
    steps = ladder(df.dropna(subset=[acts, threats, words]), words, threats, acts).withColumn("_step", F.substring("state", 2, 1).cast("double"))
    lagged = lags(steps, [threats, words], k).withColumn("_step_l1", F.lag("_step").over(ordered()))
    names = [*(f"{c}_l{j}" for c in (threats, words) for j in range(1, k + 1)), "_step_l1"]
    return expanding_fit(lagged, acts, names, max(least, len(names) + 2), "expected").withColumn("surprise", F.col(acts) - F.col("expected")).drop(*names, "_step")
