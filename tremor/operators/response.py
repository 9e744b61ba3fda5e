"""Reading impulse response tables: verdicts, roles, convolution and transmission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tier2(panel: DataFrame, macros: Sequence[str], shocks: Sequence[str], horizons: Sequence[int], macro_lags: int = 1, keys: Sequence[str] = ("panel_id",)) -> DataFrame:
    """Every macro series against every shock at every horizon, own lags as controls: the grid is stacked and fitted as one."""
    from pyspark.sql import Window

    from .gram import local_projection

    grid = F.explode(F.array(*(F.struct(F.lit(m).alias("macro"), F.lit(s).alias("shock"), F.col(m).alias("y"), F.col(s).alias("x")) for m in macros for s in shocks))).alias("g")
    long = panel.select(*keys, "t", grid).select(*keys, "t", "g.macro", "g.shock", "g.y", "g.x")
    by = [*keys, "macro", "shock"]
    w = Window.partitionBy(*by).orderBy("t")
    long = long.withColumns({f"y_l{k}": F.lag("y", k).over(w) for k in range(1, macro_lags + 1)})
    return local_projection(long, by, "y", "x", [f"y_l{k}" for k in range(1, macro_lags + 1)], horizons).drop("term")


def standardised(irf: DataFrame, spread: DataFrame, keys: Sequence[str]) -> DataFrame:
    """irf with beta_std = beta * sd_shock / sd_y; spread has keys, sd_shock, sd_y."""
    return irf.join(spread, list(keys)).withColumn("beta_std", F.try_divide(F.col("beta") * F.col("sd_shock"), F.col("sd_y")))


def significance(irf: DataFrame, keys: Sequence[str], level: float = 0.1) -> DataFrame:
    """keys, share, peak, peak_horizon: share of horizons with p below level; among those the largest absolute beta."""
    hit = F.col("p") < level
    size = F.when(hit, F.abs("beta"))
    return irf.groupBy(*keys).agg(F.avg(hit.cast("int")).alias("share"), F.max(size).alias("peak"), F.min_by("horizon", F.when(hit, F.struct(-F.abs("beta"), "horizon"))).alias("peak_horizon"))


def impact(irf: DataFrame) -> DataFrame:
    """The response at horizon 0."""
    return irf.where("horizon = 0")


def replication(irf: DataFrame, keys: Sequence[str], first: int = 1, last: int = 6, level: float = 0.1) -> DataFrame:
    """keys, replicated, trough, trough_horizon: is some beta in the horizons negative with p below level; the lowest beta."""
    part = irf.where(F.col("horizon").between(first, last))
    low = F.struct("beta", "horizon")
    return part.groupBy(*keys).agg(F.bool_or((F.col("beta") < 0) & (F.col("p") < level)).alias("replicated"), F.min("beta").alias("trough"), F.min_by("horizon", low).alias("trough_horizon"))


def shifted(raw: DataFrame, aligned: DataFrame, keys: Sequence[str], level: float = 0.1) -> DataFrame:
    """keys, shifted: raw at horizon 2 and aligned at horizon 1 are both negative and significant."""
    one = lambda irf, h, name: irf.where(F.col("horizon") == h).select(*keys, ((F.col("beta") < 0) & (F.col("p") < level)).alias(name))
    return one(raw, 2, "a").join(one(aligned, 1, "b"), list(keys)).select(*keys, (F.col("a") & F.col("b")).alias("shifted"))


def convolve(gamma: DataFrame, theta: DataFrame, last: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, channel, horizon, indirect): sum over s of gamma(s) theta(h - s); missing steps count as 0. Channel NULL: all."""
    g = gamma.select(*keys, "channel", F.col("horizon").alias("s"), F.col("beta").alias("g"))
    t = theta.select(*keys, "channel", F.col("horizon").alias("u"), F.col("beta").alias("t"))
    steps = g.join(t, [*keys, "channel"]).withColumn("horizon", F.col("s") + F.col("u")).where(F.col("horizon") <= last)
    per = steps.groupBy(*keys, "channel", "horizon").agg(F.sum(F.col("g") * F.col("t")).alias("indirect"))
    whole = per.groupBy(*keys, "horizon").agg(F.sum("indirect").alias("indirect")).withColumn("channel", F.lit(None).cast("string"))
    return per.unionByName(whole)


def transmission(indirect: DataFrame, direct: DataFrame, domestic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, horizon, direct, indirect, total, domestic): total = direct (0 if absent) + indirect; domestic NULL if absent."""
    base = indirect.where("channel is null").select(*keys, "horizon", "indirect")
    d = direct.select(*keys, "horizon", F.col("beta").alias("direct"))
    m = domestic.select(*keys, "horizon", F.col("beta").alias("domestic"))
    on = [*keys, "horizon"]
    return base.join(d, on, "left").join(m, on, "left").select(*on, F.coalesce("direct", F.lit(0.0)).alias("direct"), "indirect", (F.coalesce("direct", F.lit(0.0)) + F.col("indirect")).alias("total"), "domestic")


def tier3(panel: DataFrame, keys: Sequence[str], ret: str, channels: Sequence[str], domestic: str | None, shocks: Sequence[str], controls: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """One projection of a market return per country with roles: beta (global shocks), theta (channels), lambda (domestic)."""
    from .gram import local_projection

    if not shocks and not domestic:
        raise ValueError("at least one shock is needed")
    xs = [*shocks, *channels, *([domestic] if domestic else []), *controls]
    irf = local_projection(panel, keys, ret, xs[0], xs[1:], horizons, all_terms=True)
    role = F.when(F.col("term").isin(*shocks), "beta") if shocks else F.when(F.lit(False), "")
    if channels:
        role = role.when(F.col("term").isin(*channels), "theta")
    if domestic:
        role = role.when(F.col("term") == domestic, "lambda")
    return irf.withColumn("role", role.otherwise("control"))
