"""Many regressions as one job: grouped sums of products, small solves, influence values.

`fit` makes one pass for the sums of all models at once; coefficients, fits and inverse cross products come from k x k
solves on one row per model. Every robust variance is a sum of products of influence values, see `inference`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.dist import f_p, normal_p, ppf, t_p


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The complete cases."""
    return df.dropna(subset=list(columns))


def sums(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per model: n, means and the centred cross products of xs and y (lower triangle, y last)."""
    data = complete(df, [y, *xs])
    cols = [*xs, y]
    means = data.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"_m{k}") for k, c in enumerate(cols)))
    both = data.join(means, list(keys))
    d = [F.col(c) - F.col(f"_m{k}") for k, c in enumerate(cols)]
    pairs = [F.sum(d[i] * d[j]) for i in range(len(cols)) for j in range(i + 1)]
    return both.groupBy(*keys).agg(F.first("n").alias("n"), F.array(*(F.first(f"_m{k}") for k in range(len(cols)))).alias("means"), F.array(*pairs).alias("products"))


def _square(products: Sequence[float], k: int) -> np.ndarray:
    a = np.zeros((k, k))
    i, j = np.tril_indices(k)
    a[i, j] = a[j, i] = products
    return a


def fit(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Least squares with intercept per model: keys, n, means, beta (slopes), intercept, inverse (k x k, row by row), rss, tss.

    Models with n <= k + 1 rows give no row. A singular system takes the minimum-norm solution.
    """
    k, rows = len(xs), sums(df, keys, y, xs)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for n, means, products in zip(part["n"], part["means"], part["products"], strict=True):
                a = _square(products, k + 1)
                inv = np.linalg.pinv(a[:k, :k], hermitian=True)
                beta = inv @ a[:k, k]
                out.append((beta, means[k] - float(np.dot(beta, means[:k])), inv.ravel(), float(a[k, k] - beta @ a[:k, k]), a[k, k]))
            yield part.drop(columns="products").assign(beta=[o[0] for o in out], intercept=[o[1] for o in out], inverse=[o[2] for o in out], rss=[o[3] for o in out], tss=[o[4] for o in out])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "n long, means array<double>, beta array<double>, intercept double, inverse array<double>, rss double, tss double"])
    return rows.where(F.col("n") > k + 1).mapInPandas(solve, schema)


def influence(df: DataFrame, fitted: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], terms: Sequence[int] = (0,)) -> DataFrame:
    """Complete rows of df with resid and psi<j> = [(X'X)^-1 x]_j * resid for each wanted term."""
    both = complete(df, [y, *xs]).join(fitted.select(*keys, "n", "means", "beta", "inverse"), list(keys))
    k = len(xs)
    d = [F.col(c) - F.get("means", F.lit(i)) for i, c in enumerate(xs)]
    fitted_part = sum((d[i] * F.get("beta", F.lit(i)) for i in range(k)), F.lit(0.0))
    both = both.withColumn("resid", F.col(y) - F.get("means", F.lit(k)) - fitted_part)
    return both.withColumns({f"psi{j}": sum((F.get("inverse", F.lit(j * k + i)) * d[i] for i in range(k)), F.lit(0.0)) * F.col("resid") for j in terms})


def lag_products(psi: Column, other: Column, order: Window, lags: int, width: Column) -> Column:
    """psi_t other_t plus Bartlett-weighted products with lags up to `width` (at most `lags`) either way."""
    out = psi * other
    for m in range(1, lags + 1):
        weight = F.when(F.lit(m) <= width, 1 - m / (width + 1)).otherwise(0.0)
        out = out + weight * (psi * F.coalesce(F.lag(other, m).over(order), F.lit(0.0)) + other * F.coalesce(F.lag(psi, m).over(order), F.lit(0.0)))
    return out


def inference(rows: DataFrame, fitted: DataFrame, keys: Sequence[str], xs: Sequence[str], terms: Sequence[int], order: str = "t", kind: str = "hac", lags: int = 0, width: Column | None = None, ci: float = 0.9) -> DataFrame:
    """Per model and term: beta, se, t, p, lo, hi, nobs. kind: hac (Newey-West, `width` lags, at most `lags`) or hc1.

    rows: what `influence` gives. Normal p-values and bounds.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    width = F.lit(lags) if width is None else width
    square = {j: lag_products(F.col(f"psi{j}"), F.col(f"psi{j}"), w, lags, width) if kind == "hac" else F.col(f"psi{j}") * F.col(f"psi{j}") for j in terms}
    each = rows.select(*keys, *(square[j].alias(f"v{j}") for j in terms)).groupBy(*keys).agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in terms))
    factor = F.lit(1.0) if kind == "hac" else F.col("n") / (F.col("n") - len(xs) - 1)
    long = fitted.join(each, list(keys)).select(*keys, "n", F.explode(F.array(*(F.struct(F.lit(xs[j]).alias("term"), F.get("beta", F.lit(j)).alias("beta"), F.sqrt(factor * F.col(f"v{j}")).alias("se")) for j in terms))).alias("e"))
    z = ppf(0.5 + ci / 2)

    @F.pandas_udf("double")
    def two_sided(t: pd.Series) -> pd.Series:
        return t.map(lambda v: None if pd.isna(v) else normal_p(v))

    out = long.select(*keys, "e.term", "e.beta", "e.se", F.col("n").alias("nobs")).withColumn("t", F.try_divide("beta", "se"))
    return out.withColumns({"p": two_sided("t"), "lo": F.col("beta") - z * F.col("se"), "hi": F.col("beta") + z * F.col("se")})


def ols_table(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Classical least squares per model and term: beta, se, t, p (Student), nobs, r2, intercept."""
    fitted, k = fit(df, keys, y, xs), len(xs)
    dof = F.col("n") - k - 1
    terms = F.explode(F.array(*(F.struct(F.lit(x).alias("term"), F.get("beta", F.lit(j)).alias("beta"), F.sqrt(F.get("inverse", F.lit(j * k + j)) * F.col("rss") / dof).alias("se")) for j, x in enumerate(xs)))).alias("e")

    @F.pandas_udf("double")
    def student(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else t_p(a, b) for a, b in zip(t, d, strict=True)], dtype=float)

    out = fitted.select(*keys, "n", "intercept", (1 - F.try_divide("rss", "tss")).alias("r2"), dof.alias("dof"), terms)
    out = out.select(*keys, "e.term", "e.beta", "e.se", F.try_divide("e.beta", "e.se").alias("t"), "intercept", "r2", F.col("n").alias("nobs"), "dof")
    return out.withColumn("p", student("t", "dof")).drop("dof")


def local_projection(df: DataFrame, keys: Sequence[str], y: str, shock: str, controls: Sequence[str] = (), horizons: Sequence[int] = range(6), kind: str = "hac", max_lags: int | None = None, lags: int = 0, ci: float = 0.9, all_terms: bool = False, order: str = "t") -> DataFrame:
    """Impulse responses of y to shock at every horizon of every model (keys), in one job.

    At h: y(t+h) on shock(t) and controls(t), on the rows complete for that h. kind 'hac' takes max(max_lags, h) lags
    (max_lags: the largest horizon by default); 'lag_augmented' adds `lags` lags of y and shock and uses HC1.
    Columns: keys, horizon, term, beta, se, nobs, t, p, lo, hi; term is the shock unless all_terms.
    """
    horizons, models = list(horizons), [*keys, "horizon"]
    stacked, xs = projected(df, keys, y, shock, controls, horizons, kind, lags, order)
    fitted = fit(stacked, models, "y_lead", xs)
    terms = list(range(len(xs))) if all_terms else [0]
    rows = influence(stacked, fitted, models, "y_lead", xs, terms)
    if kind == "hac":
        widest = max(horizons) if max_lags is None else max_lags
        return inference(rows, fitted, models, xs, terms, order, "hac", max(widest, *horizons), F.greatest(F.lit(widest), F.col("horizon")), ci)
    return inference(rows, fitted, models, xs, terms, order, "hc1", ci=ci)


def projected(df: DataFrame, keys: Sequence[str], y: str, shock: str, controls: Sequence[str], horizons: Sequence[int], kind: str = "hac", lags: int = 0, order: str = "t") -> tuple[DataFrame, list[str]]:
    """df once for each horizon with y_lead, and the regressors of the projection, the shock first."""
    by = Window.partitionBy(*keys).orderBy(order)
    if kind not in ("hac", "lag_augmented"):
        raise ValueError(f"unknown inference {kind}")
    if kind == "lag_augmented":
        if lags < 1:
            raise ValueError("lag augmentation needs at least one lag")
        df = df.withColumns({f"_{c}_l{m}": F.lag(c, m).over(by) for c in (y, shock) for m in range(1, lags + 1)})
        controls = [*controls, *(f"_{c}_l{m}" for c in (y, shock) for m in range(1, lags + 1))]
    xs = [shock, *controls]
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lead(y, h).over(by).alias("y_lead")) for h in horizons))
    stacked = df.select(*keys, order, *dict.fromkeys(xs), each.alias("_e")).withColumn("_e", F.explode("_e")).select(*keys, order, *dict.fromkeys(xs), "_e.horizon", "_e.y_lead")
    return stacked, xs


def orthogonal(df: DataFrame, keys: Sequence[str], target: str, on: Sequence[str], out: str = "orthogonal") -> DataFrame:
    """df with the residual of target on `on` (full sample, per model); rows that aren't complete get NULL."""
    fitted = fit(df, keys, target, on).select(*keys, "means", "beta")
    both = df.join(fitted, list(keys), "left")
    part = sum(((F.col(c) - F.get("means", F.lit(i))) * F.get("beta", F.lit(i)) for i, c in enumerate(on)), F.lit(0.0))
    return both.withColumn(out, F.col(target) - F.get("means", F.lit(len(on))) - part).drop("means", "beta")


def ar_orders(df: DataFrame, top: int = 5, criterion: str = "bic", least: int = 10) -> DataFrame:
    """(series_id, p, criterion, nobs) of AR(p), p = 0 .. top, each on its own complete rows, at most n // 5 lags."""
    w = Window.partitionBy("series_id").orderBy("date")
    dense = df.where("value is not null").withColumn("_n", F.count("*").over(Window.partitionBy("series_id")))
    dense = dense.withColumns({f"l{k}": F.lag("value", k).over(w) for k in range(1, top + 1)})
    out = None
    for p in range(top + 1):
        xs = [f"l{k}" for k in range(1, p + 1)]
        if p:
            fitted = fit(dense.where(F.col("_n") >= 5 * p), ["series_id"], "value", xs)
        else:
            fitted = dense.groupBy("series_id").agg(F.count("*").alias("n"), (F.var_pop("value") * F.count("*")).alias("rss"))
        penalty = F.log(F.col("n")) if criterion == "bic" else F.lit(2.0)
        # Gaussian likelihood with the variance counted as a parameter.
        ic = F.col("n") * (F.log(F.lit(2 * np.pi)) + F.log(F.col("rss") / F.col("n")) + 1) + penalty * (p + 2)
        one = fitted.where((F.col("n") >= least) & (F.col("rss") > 0)).select("series_id", F.lit(p).alias("p"), ic.alias(criterion), F.col("n").alias("nobs"))
        out = one if out is None else out.unionByName(one)
    return out


def best_order(orders: DataFrame, criterion: str = "bic") -> DataFrame:
    return orders.groupBy("series_id").agg(F.min_by("p", F.struct(criterion, "p")).alias("p"))


def shapley_r2(df: DataFrame, keys: Sequence[str], y: str, channels: Sequence[str], controls: Sequence[str] = ()) -> DataFrame:
    """(keys, channel, share): each channel's average gain in R2 over all orders of entry, controls always in. One pass
    over the rows; the 2^K subset fits are solved on the cross products of each model (at most 15 channels)."""
    if len(channels) > 15:
        raise ValueError("at most 15 channels")
    from math import factorial

    xs, k, c = [*channels, *controls], len(channels), len(controls)
    weight = [factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                a = _square(row.products, len(xs) + 1)
                r2 = np.zeros(1 << k)
                for mask in range(1 << k):
                    on = [i for i in range(k) if mask >> i & 1] + list(range(k, k + c))
                    r2[mask] = a[on, -1] @ np.linalg.pinv(a[np.ix_(on, on)], hermitian=True) @ a[on, -1] / a[-1, -1] if on and a[-1, -1] else 0.0
                for i, name in enumerate(channels):
                    gain = sum(weight[bin(m).count("1")] * (r2[m | 1 << i] - r2[m]) for m in range(1 << k) if not m >> i & 1)
                    out.append((*(getattr(row, x) for x in keys), name, gain, r2[-1], r2[0]))
            yield pd.DataFrame(out, columns=[*keys, "channel", "share", "r2_full", "r2_base"])

    kinds = dict(df.dtypes)
    return sums(df, keys, y, xs).mapInPandas(solve, ", ".join([*(f"{x} {kinds[x]}" for x in keys), "channel string, share double, r2_full double, r2_base double"]))


def block_var(df: DataFrame, x: Sequence[str], z: Sequence[str], order: int, by: str = "series_id", t: str = "t") -> DataFrame:
    """(by, equation, regressor, coef, rss, nobs): x-equations on lags of x only, z-equations on lags of both."""
    w = Window.partitionBy(by).orderBy(t)
    names = {c: [f"{c}_l{m}" for m in range(1, order + 1)] for c in (*x, *z)}
    lagged = df.withColumns({f"{c}_l{m}": F.lag(c, m).over(w) for c in (*x, *z) for m in range(1, order + 1)})
    out = None
    for c in (*x, *z):
        xs = [n for s in (x if c in x else (*x, *z)) for n in names[s]]
        one = fit(lagged, [by], c, xs).select(by, F.lit(c).alias("equation"), F.posexplode("beta").alias("k", "coef"), "rss", F.col("n").alias("nobs"))
        one = one.withColumn("regressor", F.element_at(F.array(*map(F.lit, xs)), F.col("k") + 1)).drop("k")
        out = one if out is None else out.unionByName(one)
    return out


def block_granger(df: DataFrame, x: Sequence[str], z: Sequence[str], order: int, by: str = "series_id", t: str = "t") -> DataFrame:
    """(by, f, p, q, dof): pooled F test that lags of z stay out of all x-equations, on the common complete rows."""
    w = Window.partitionBy(by).orderBy(t)
    mine, other = ([f"{c}_l{m}" for c in g for m in range(1, order + 1)] for g in (x, z))
    lagged = complete(df.withColumns({f"{c}_l{m}": F.lag(c, m).over(w) for c in (*x, *z) for m in range(1, order + 1)}), [*x, *mine, *other])
    parts = None
    for c in x:
        short = fit(lagged, [by], c, mine).select(by, "n", F.col("rss").alias("r0"))
        one = fit(lagged, [by], c, [*mine, *other]).select(by, F.col("rss").alias("r1")).join(short, by)
        parts = one if parts is None else parts.unionByName(one)
    q, k = len(x) * len(other), len(mine) + len(other) + 1
    total = parts.groupBy(by).agg(F.sum("r0").alias("r0"), F.sum("r1").alias("r1"), F.first("n").alias("n"))
    total = total.withColumn("dof", len(x) * (F.col("n") - k)).withColumn("f", F.try_divide((F.col("r0") - F.col("r1")) / q, F.col("r1") / F.col("dof")))

    @F.pandas_udf("double")
    def tail(f: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else f_p(a, q, b) for a, b in zip(f, d, strict=True)], dtype=float)

    return total.select(by, "f", tail("f", "dof").alias("p"), F.lit(q).alias("q"), "dof")
