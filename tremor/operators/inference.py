"""Further inference on projections: simultaneous bands, quantile fits, equality tests, fixed effects, lead-lag profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.dist import norm_two_sided, ppf

from .gram import complete, fit, influence, lag_products, local_projection, projected
from .quantiles import quantile_fit, student_p
from .timealign import leads


def scaled_influence(df: DataFrame, keys: Sequence[str], y: str, shock: str, controls: Sequence[str], horizons: Sequence[int], kind: str = "hac", lags: int = 0) -> DataFrame:
    """(keys, horizon, t, psi0, ...): the shock's influence values at every horizon, times the root of the HC1 factor."""
    models = [*keys, "horizon"]
    stacked, xs = projected(df, keys, y, shock, controls, list(horizons), kind, lags)
    rows = influence(stacked, fit(stacked, models, "y_lead", xs), models, "y_lead", xs)
    return rows.withColumn("psi0", F.col("psi0") * F.sqrt(F.col("n") / (F.col("n") - len(xs) - 1)))


def sup_t(df: DataFrame, keys: Sequence[str], y: str, shock: str, controls: Sequence[str], horizons: Sequence[int], kind: str = "hac", lags: int = 0, ci: float = 0.9, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """(keys, horizon, beta, se, critical, lo, hi): bands of the shock's response that hold at all horizons at once.

    beta and se are those of `local_projection` with the same kind and lags. The horizons' covariance is one aggregate over
    influence values with the HC1 factor, each pair of horizons over the rows that both have. The critical value is the ci
    quantile of the largest of correlated normals; with one horizon it is the pointwise one.
    """
    horizons, models = list(horizons), [*keys, "horizon"]
    psi = scaled_influence(df, keys, y, shock, controls, horizons, kind, lags).groupBy(*keys, "t").pivot("horizon", horizons).agg(F.first("psi0"))
    # A product with an absent value is NULL, which sums leave out.
    pairs = [F.coalesce(F.sum(F.col(str(a)) * F.col(str(b))), F.lit(0.0)) for i, a in enumerate(horizons) for b in horizons[: i + 1]]

    def critical(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for products in part["products"]:
                a = np.zeros((len(horizons),) * 2)
                i, j = np.tril_indices(len(horizons))
                a[i, j] = a[j, i] = products
                sd = np.sqrt(np.maximum(np.diag(a), 1e-300))
                value, vector = np.linalg.eigh(a / sd[:, None] / sd)
                root = vector * np.sqrt(np.maximum(value, 0))
                z = np.abs(np.random.default_rng(seed).standard_normal((draws, len(sd))) @ root.T).max(axis=1)
                out.append(float(np.quantile(z, ci)) if len(sd) > 1 else ppf(0.5 + ci / 2))
            yield part.drop(columns="products").assign(critical=out)

    kinds = dict(df.dtypes)
    bands = psi.groupBy(*keys).agg(F.array(*pairs).alias("products"))
    widths = bands.mapInPandas(critical, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "critical double"]))
    irf = local_projection(df, keys, y, shock, controls, horizons, kind, lags=lags, ci=ci).select(*models, "beta", "se")
    out = irf.join(widths, list(keys))
    return out.withColumns({"lo": F.col("beta") - F.col("critical") * F.col("se"), "hi": F.col("beta") + F.col("critical") * F.col("se")})


def quantile_projection(df: DataFrame, keys: Sequence[str], y: str, shock: str, controls: Sequence[str], horizons: Sequence[int], tau: float = 0.5) -> DataFrame:
    """(keys, horizon, beta, se, t, p, nobs): the shock's effect on the tau-quantile of y at every horizon, with Student
    p-values; simultaneous bands are not to be had for quantiles, see `sup_t`."""
    stacked, k = leads(df, y, list(horizons), tuple(keys)), len(controls) + 1
    out = quantile_fit(stacked, [*keys, "horizon"], "y_lead", [shock, *controls], tau)
    out = out.select(*keys, "horizon", F.get("beta", F.lit(0)).alias("beta"), F.get("se", F.lit(0)).alias("se"), F.col("n").alias("nobs"))
    out = out.withColumn("t", F.try_divide("beta", "se"))
    return out.withColumn("p", student_p("t", F.col("nobs") - k - 1))


def equal_terms(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], lags: int = 5, order: str = "t") -> DataFrame:
    """(keys, gap, se, z, p): is the first regressor's coefficient equal to the second's; Newey-West on their difference."""
    fitted = fit(df, keys, y, xs)
    psi = influence(df, fitted, keys, y, xs, (0, 1)).withColumn("_d", F.col("psi0") - F.col("psi1"))
    w = Window.partitionBy(*keys).orderBy(order)
    square = lag_products(F.col("_d"), F.col("_d"), w, lags, F.lit(lags))
    var = psi.select(*keys, square.alias("v")).groupBy(*keys).agg(F.sum("v").alias("v"))
    out = fitted.join(var, list(keys)).select(*keys, (F.get("beta", F.lit(0)) - F.get("beta", F.lit(1))).alias("gap"), F.sqrt("v").alias("se"))
    return out.withColumn("z", F.try_divide("gap", "se")).withColumn("p", norm_two_sided(F.col("z")))


def fixed_effects(df: DataFrame, keys: Sequence[str], unit: str, y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with an effect of each unit: values less their unit's mean, then one fit per model."""
    w = Window.partitionBy(*keys, unit)
    within = complete(df, [y, *xs]).withColumns({c: F.col(c) - F.avg(c).over(w) for c in (y, *xs)})
    return fit(within, keys, y, xs)


def lead_lag(df: DataFrame, x: str, y: str, reach: int, by: str = "series_id", order: str = "date") -> DataFrame:
    """(by, lag, corr, n): correlation of x(t) with y(t + lag), lag from -reach to reach."""
    w = Window.partitionBy(by).orderBy(order)
    each = F.array(*(F.struct(F.lit(k).alias("lag"), (F.lead(y, k) if k >= 0 else F.lag(y, -k)).over(w).alias("v")) for k in range(-reach, reach + 1)))
    long = df.select(by, x, each.alias("_e")).withColumn("_e", F.explode("_e")).select(by, x, "_e.lag", "_e.v").dropna()
    return long.groupBy(by, "lag").agg(F.corr(x, "v").alias("corr"), F.count("*").alias("n"))


def contributions(values: DataFrame, theta: DataFrame) -> DataFrame:
    """values (channel, date, value) with effect = theta * value and share of the day's absolute effects."""
    out = values.join(theta, "channel").withColumn("effect", F.col("theta") * F.col("value"))
    return out.withColumn("share", F.try_divide(F.abs("effect"), F.sum(F.abs("effect")).over(Window.partitionBy("date"))))
