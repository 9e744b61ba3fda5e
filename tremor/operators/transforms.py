"""Projections over the long series table (series_id, date, value): transforms, policies, availability, melting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def by_series():
    """Each series in time order."""
    return Window.partitionBy("series_id").orderBy("date")


def clean(x: Column) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def dlog(x: Column, window=None) -> Column:
    """Log return against the adjacent row; a missing value blanks two rows."""
    return safe_log(x) - F.lag(safe_log(x)).over(window or by_series())


def diff(x: Column, window=None) -> Column:
    return x - F.lag(x).over(window or by_series())


def growth(x: Column, window=None) -> Column:
    """Percent growth: 100 times the log return."""
    return 100 * dlog(x, window)


def dlog_dense(df: DataFrame) -> DataFrame:
    """Log returns of (series_id, date, value) after dropping nulls, so that a gap is bridged."""
    return df.where("value is not null").withColumn("value", dlog(F.col("value"))).where("value is not null")


# How each kind of series is made stationary. Fixed values.
POLICY = {"price": dlog, "index": growth, "level": lambda x, w=None: x, "rate": diff, "log1p": lambda x, w=None: log1p(x)}


def apply_policy(df: DataFrame, kinds: DataFrame) -> DataFrame:
    """(series_id, date, value) with each series transformed by its kind in kinds (series_id, kind); other series go."""
    chosen = df.join(kinds, "series_id")
    out = F.lit(None).cast("double")
    for kind, f in POLICY.items():
        out = F.when(F.col("kind") == kind, f(F.col("value"), by_series())).otherwise(out)
    return chosen.withColumn("value", out).drop("kind")


def kinds(spark, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), "series_id string, kind string")


def zscore(x: Column, window=None) -> Column:
    """Full-sample z-score; NULL where the deviation is 0. Looks ahead by design: for control only."""
    w = window or Window.partitionBy("series_id")
    return F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def available_at(kind: str, date: Column) -> Column:
    """When a value dated `date` can be known: daily and monthly index releases, market closes (UTC)."""
    day = date.cast("timestamp")
    if kind == "daily":
        return day + F.expr("interval 36 hours")
    if kind == "monthly":
        return F.add_months(F.trunc(date, "MM"), 1).cast("timestamp") + F.expr("interval 132 hours")
    if kind == "market":
        return day + F.expr("interval 23 hours")
    raise ValueError(f"no release rule for {kind!r}")


def melt(wide: DataFrame, columns: Sequence[str], **provenance: str) -> DataFrame:
    """Wide to long (series_id, date, value, provenance...); null values go."""
    long = wide.unpivot(["date"], list(columns), "series_id", "value").where("value is not null")
    return long.withColumns({k: F.lit(v) for k, v in provenance.items()}) if provenance else long


def between(df: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Rows dated from first to last, both included; None leaves an end open."""
    if first:
        df = df.where(F.col("date") >= F.lit(first).cast("date"))
    return df.where(F.col("date") <= F.lit(last).cast("date")) if last else df


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, or an error that names the missing and the present columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns {missing}; present: {df.columns}")
    return df


def level_plus_jump(level: Column, jump: Column) -> Column:
    """A raw sum on two scales, by intention; NULL if either is."""
    return level + jump


def tag_samples(df: DataFrame, samples: DataFrame) -> DataFrame:
    """df by sub-sample: samples (sample, first, last), null ends open; a row comes once for each sample that covers it."""
    inside = (F.coalesce(F.col("date") >= F.col("first"), F.lit(True))) & (F.coalesce(F.col("date") <= F.col("last"), F.lit(True)))
    return df.join(F.broadcast(samples), inside).drop("first", "last")


def eligible(shock_type: Column) -> Column:
    """Whether a shock type may enter a gate: only those without look-ahead."""
    return shock_type.isin("INNOVATION", "JUMP", "LEVEL_PLUS_JUMP")
