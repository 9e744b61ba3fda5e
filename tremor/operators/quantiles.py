"""Exact quantile regression: vertices of the linear program, bounded per group, with sandwich errors.

A group of any size is solved in bounded tasks. A hashed sample gives a first plane; rows far above or below it can't touch the
optimum and enter as one sum each; the rows near it, together with these sums, are solved exactly; a pass over all rows counts
those whose side was guessed wrong, and where there are any the band is doubled around the new plane. With none left, the
plane is the optimum of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.dist import ppf, t_p
from tremor.sources.shared import written

ON_PLANE = 1e-9  # residuals of so many standard deviations of y are those of rows on the plane, and not positive
BAND = 4000  # rows of one group that a task solves at once, about, at first
EXACT_QUARTILES = 1_000_000  # up to so many rows a group, quartiles of residuals are exact


def exact(x: np.ndarray, y: np.ndarray, tau: float, pull: np.ndarray | None = None) -> np.ndarray:
    """The coefficients b that minimise the check loss of y - x b less pull b, at a vertex.

    Starts at the vertex next to a reweighted least-squares fit and moves along edges: the steepest one, as far as the loss
    falls. Columns that depend on others get 0. `pull` is the sum of tau x over rows that surely lie above and of
    (tau - 1) x over rows that surely lie below; NaN where these sums pull the plane beyond all given rows.
    """
    size = np.maximum(np.abs(x).max(axis=0), 1e-300)
    x, pull = x / size, np.zeros(x.shape[1]) if pull is None else pull / size
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(12):
        r = y - x @ b
        w = np.where(r >= 0, tau, 1 - tau) / np.maximum(np.abs(r), 1e-6 * max(np.abs(r).mean(), 1e-300))
        b = np.linalg.pinv(x.T @ (x * w[:, None]), hermitian=True) @ (x.T @ (w * y) + pull)
    basis, span = [], np.zeros((0, x.shape[1]))
    for i in np.argsort(np.abs(y - x @ b), kind="stable"):
        left = x[i] - span.T @ (span @ x[i])
        if (norm := np.linalg.norm(left)) > 1e-9:
            basis.append(int(i))
            span = np.vstack([span, left / norm])
        if len(basis) == x.shape[1]:
            break
    kept = np.arange(x.shape[1])
    if len(basis) < len(kept):  # dependent columns
        kept, span = [], np.zeros((0, len(x)))
        for j in range(x.shape[1]):
            left = x[:, j] - span.T @ (span @ x[:, j])
            if np.linalg.norm(left) > 1e-9 * np.linalg.norm(x[:, j]):
                kept.append(j)
                span = np.vstack([span, left / np.linalg.norm(left)])
        out = np.zeros(x.shape[1])
        out[kept] = exact(x[:, kept], y, tau, pull[kept])
        return out / size
    slack = 1e-9 * (np.abs(x).sum(axis=0).max() + np.abs(pull).max() + 1)
    for _ in range(50 * (x.shape[1] + 1) + len(x)):
        edges = np.linalg.inv(x[basis])
        b = edges @ y[basis]
        r = y - x @ b
        r[basis] = 0
        side = np.where(r < 0, tau - 1, tau)
        side[basis] = 0
        u = (side @ x + pull) @ edges
        falls = np.maximum(u - (1 - tau), -u - tau)
        j = int(np.argmax(falls))
        if falls[j] <= slack:
            break
        step = edges[:, j] * (1 if u[j] > 0 else -1)
        a = x @ step
        a[basis] = 0
        meets = np.flatnonzero((r >= 0) & (a > 1e-12) | (r < 0) & (a < -1e-12))
        order = meets[np.argsort(r[meets] / a[meets], kind="stable")]
        far = np.searchsorted(np.cumsum(np.abs(a[order])), falls[j])
        if far >= len(order):
            return np.full(x.shape[1], np.nan)
        basis[j] = int(order[far])
    return b / size


def bandwidth(n: float, tau: float, spread: float) -> float:
    """Hall and Sheather's bandwidth at tau, in units of the residuals (`spread`: the smaller of sd(y) and IQR / 1.34)."""
    z = ppf(tau)
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    h = n ** (-1 / 3) * ppf(0.975) ** (2 / 3) * (1.5 * density**2 / (2 * z * z + 1)) ** (1 / 3)
    return spread * (ppf(min(tau + h, 1 - 1e-12)) - ppf(max(tau - h, 1e-12)))


def sandwich(x: np.ndarray, y: np.ndarray, b: np.ndarray, tau: float) -> np.ndarray:
    """Standard errors of one fit from all its rows."""
    e = y - x @ b
    low, high = np.percentile(e, [25, 75])
    h = bandwidth(len(y), tau, min(y.std(), (high - low) / 1.34))
    if not h > 0:
        return np.full(len(b), np.nan)
    near = np.abs(e / h)
    kernel = np.where(near <= 1, 0.75 * (1 - near**2), 0).sum()
    meat = x.T @ (x * np.where(e > ON_PLANE * y.std(), tau**2, (1 - tau) ** 2)[:, None])
    return _errors(x.T @ x, meat, kernel, len(y) * h)


def _errors(bread: np.ndarray, meat: np.ndarray, kernel: float, width: float) -> np.ndarray:
    inverse = np.linalg.pinv(bread, hermitian=True)
    return np.sqrt(np.diag(inverse @ meat @ inverse)) * width / kernel if kernel > 0 else np.full(len(bread), np.nan)


def _typed(df: DataFrame, keys: Sequence[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{c} {kinds[c]}" for c in keys), more])


def _solved(rows: DataFrame, keys: Sequence[str], k: int, tau: float) -> DataFrame:
    """(keys, coef) of groups with `cells` (each row's regressors and outcome) and `pull`."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for cells, pull in zip(part["cells"], part["pull"], strict=True):
                data = np.array([np.asarray(c, float) for c in cells])
                coef = exact(data[:, :k], data[:, k], tau, None if pull is None else np.asarray(pull, float))
                out.append(None if np.isnan(coef).any() else coef)
            yield part[list(keys)].assign(coef=out)

    return rows.select(*keys, "cells", "pull").mapInPandas(solve, _typed(rows, keys, "coef array<double>"))


def quantile_fit(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], tau: float = 0.5, band: int = BAND) -> DataFrame:
    """(keys, intercept, beta, se, n) of the tau-quantile regression of y on xs per model, an exact optimum; se belongs to
    beta and is the sandwich with a kernel estimate of the density at the quantile.

    Models with n <= k + 1 complete rows give no row. A group of up to `band` rows is one small task; of larger ones only about
    `band` rows meet, see the module. Where several planes are optimal, one of them is returned.
    """
    if not 0 < tau < 1:
        raise ValueError(f"tau {tau} isn't between 0 and 1")
    keys, k = list(keys), len(xs) + 1
    cells = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in xs), F.col(y).cast("double"))
    data = df.dropna(subset=[y, *xs]).select(*keys, cells.alias("cells"))
    sizes = data.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > k)
    rows = data.join(sizes, keys)
    chance = F.pmod(F.xxhash64("cells", *keys), F.lit(1 << 30)) / (1 << 30)
    first = rows.where((F.col("n") <= band) | (chance < F.lit(band) / F.col("n")))
    none = F.lit(None).cast("array<double>")
    coef = _solved(first.groupBy(*keys).agg(F.collect_list("cells").alias("cells"), none.alias("pull")), keys, k, tau)
    off = lambda name: F.get("cells", F.lit(k)) - reduce(lambda a, b: a + b, (F.get("cells", F.lit(i)) * F.get(name, F.lit(i)) for i in range(k)))
    if not sizes.where(F.col("n") > band).isEmpty():
        rows, coef = written(rows, "rows"), written(coef, "planes")
        big, wide, wrong = rows.where(F.col("n") > band), band, True
        while wrong:
            far = big.join(coef, keys).withColumn("off", off("coef"))
            split = far.join(_edges(far, keys, wide), keys)
            near, side = F.abs("off") <= F.col("edge"), F.when(F.col("off") < 0, tau - 1).otherwise(tau)
            pulls = F.array(*(F.sum(F.when(near, 0.0).otherwise(side * F.get("cells", F.lit(i)))) for i in range(k)))
            groups = split.groupBy(*keys).agg(F.collect_list(F.when(near, F.col("cells"))).alias("cells"), pulls.alias("pull"))
            better = written(_solved(groups, keys, k, tau).withColumnRenamed("coef", "new"), "planes")
            moved = split.where(~near).join(better, keys).where((F.col("off") < 0) != (off("new") < 0))
            wrong = not moved.isEmpty() or not better.where("new is null").isEmpty()
            coef = written(coef.join(better, keys, "left").select(*keys, F.coalesce("new", "coef").alias("coef")), "planes")
            wide *= 2
    return _with_errors(rows, coef, keys, k, tau, off)


def _edges(big: DataFrame, keys: Sequence[str], wide: int) -> DataFrame:
    """(keys, edge): the distance from its plane within which about `wide` rows of each group lie."""
    bucket = F.floor(F.log2(F.greatest(F.abs("off"), F.lit(1e-300))) * 8)  # distances in steps of 9 percent
    per = big.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("m"), F.max(F.abs("off")).alias("top"))
    upto = per.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys).orderBy("bucket")))
    enough = upto.where(F.col("upto") >= wide).groupBy(*keys).agg(F.min("top").alias("edge"))
    every = upto.groupBy(*keys).agg(F.max("top").alias("last"))
    return every.join(enough, list(keys), "left").select(*keys, F.coalesce("edge", "last").alias("edge"))


def _with_errors(rows: DataFrame, coef: DataFrame, keys: list[str], k: int, tau: float, off) -> DataFrame:
    """(keys, intercept, beta, se, n): two passes over all rows, one for the bandwidth and one for sums of products."""
    fitted = rows.join(coef, keys).withColumn("off", off("coef"))
    largest = rows.agg(F.max("n")).first()[0] or 0
    quarter: Column = F.percentile("off", F.array(F.lit(0.25), F.lit(0.75))) if largest <= EXACT_QUARTILES else F.percentile_approx("off", [0.25, 0.75], 100_000)
    spread = fitted.groupBy(*keys).agg(F.count("*").alias("n"), quarter.alias("q"), F.stddev_pop(F.get("cells", F.lit(k))).alias("sd"), F.first("coef").alias("coef"))

    def widths(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(h=[bandwidth(n, tau, min(sd, (q[1] - q[0]) / 1.34)) for n, q, sd in zip(part["n"], part["q"], part["sd"], strict=True)])[[*keys, "n", "coef", "sd", "h"]]

    wide = spread.mapInPandas(widths, _typed(rows, keys, "n long, coef array<double>, sd double, h double"))
    both = fitted.select(*keys, "cells", "off").join(wide, keys)
    at = lambda i: F.get("cells", F.lit(i))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    u, weight = F.try_divide("off", "h"), F.when(F.col("off") > ON_PLANE * F.col("sd"), tau**2).otherwise((1 - tau) ** 2)
    kernel = F.sum(F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0))
    sums = both.groupBy(*keys).agg(F.first("n").alias("n"), F.first("coef").alias("coef"), F.first("h").alias("h"), kernel.alias("kernel"), F.array(*(F.sum(at(i) * at(j)) for i, j in pairs)).alias("bread"), F.array(*(F.sum(weight * at(i) * at(j)) for i, j in pairs)).alias("meat"))

    def errors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def square(half):
            a = np.zeros((k, k))
            i, j = np.tril_indices(k)
            a[i, j] = a[j, i] = half
            return a

        for part in parts:
            out = [_errors(square(b), square(m), s, n * h) for b, m, s, n, h in zip(part["bread"], part["meat"], part["kernel"], part["n"], part["h"], strict=True)]
            yield part[keys].assign(intercept=[c[0] for c in part["coef"]], beta=[c[1:] for c in part["coef"]], se=[e[1:] for e in out], n=part["n"])

    return sums.mapInPandas(errors, _typed(rows, keys, "intercept double, beta array<double>, se array<double>, n long"))


def student_p(t: str, dof: Column) -> Column:
    """Two-sided p-values of Student's t."""

    @F.pandas_udf("double")
    def tail(values: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_p(a, d) for a, d in zip(values, free, strict=True)], dtype=float)

    return tail(t, dof)
