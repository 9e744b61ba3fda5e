"""The long, versioned series store: schemas, guarded scans, point-in-time reads, merges, fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators.transforms import clean, require

SCHEMAS = {
    "ext_series": "series_id string, date date, value double, freq string, source string, available_at timestamp, revised_at timestamp, source_version string, data_version string, quality_flag string, loaded_at timestamp",
    "risk_indices": "index_name string, freq string, date date, value double, zscore double, pct_rank double, version string, computed_at timestamp",
    "index_quality": "index_name string, date date, n_sources int, coverage double, complete boolean, version string",
    "data_versions": "version string, created_at timestamp, note string",
}
KEYS = {"ext_series": ["series_id", "date", "data_version"], "risk_indices": ["index_name", "freq", "date", "version"], "index_quality": ["index_name", "date", "version"], "data_versions": ["version"]}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """An empty typed frame of a store table."""
    return spark.createDataFrame([], SCHEMAS[name])


def create(spark: SparkSession, name: str) -> None:
    spark.sql(f"create table if not exists {name} ({SCHEMAS[name]}) using parquet")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """date and columns of a landed file: required columns are checked, null dates go, NaN becomes NULL."""
    require(df, ["date", *columns])
    kind = dict(df.dtypes)
    return df.where("date is not null").select(F.col("date").cast("date").alias("date"), *(clean(F.col(c)).alias(c) if kind[c] in ("double", "float") else F.col(c) for c in columns))


def scan_prefixed(df: DataFrame, prefix: str, must: Sequence[str] = ()) -> DataFrame:
    """date, `must` and every column that starts with `prefix`; an error lists the codes on hand."""
    if missing := [c for c in must if c not in df.columns]:
        raise ValueError(f"missing {missing}; codes: {sorted(c for c in df.columns if c.startswith(prefix))}")
    return scan(df, [*must, *(c for c in df.columns if c.startswith(prefix) and c not in must)])


def load_keyed(df: DataFrame, codes: dict[str, str], first: str | None = None, last: str | None = None, scale: dict[str, float] | None = None) -> DataFrame:
    """Provider codes to series names, some rescaled, in a date range: (series_id, date, value)."""
    names = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
    out = df.where(F.col("series_id").isin(*codes)).withColumn("series_id", names[F.col("series_id")])
    for name, factor in (scale or {}).items():
        out = out.withColumn("value", F.when(F.col("series_id") == name, F.col("value") * factor).otherwise(F.col("value")))
    if first:
        out = out.where(F.col("date") >= F.lit(first).cast("date"))
    return out.where(F.col("date") <= F.lit(last).cast("date")) if last else out


def dispatch(sources: dict[str, Callable[..., DataFrame]], name: str, *args) -> DataFrame:
    """The frame of a named source; an unknown or unconnected one is an error."""
    if sources.get(name) is None:
        raise ValueError(f"source {name!r} is unknown or not connected; connected: {sorted(k for k, v in sources.items() if v)}")
    return sources[name](*args)


def as_of(store: DataFrame, ids: Sequence[str] | None, when: str, freq: str | None = None, version: str | None = None) -> DataFrame:
    """Rows of the store known at `when`: available_at <= when, for some ids, frequency and version."""
    out = store.where(F.col("available_at") <= F.lit(when).cast("timestamp"))
    if ids:
        out = out.where(F.col("series_id").isin(*ids))
    if freq:
        out = out.where(F.col("freq") == freq)
    return out.where(F.col("data_version") == version) if version else out


def wide(long: DataFrame, ids: Sequence[str], check: bool = True) -> DataFrame:
    """Long to wide by date; a repeated (date, series_id) is an error when `check` is on."""
    if check and not repeated_keys(long, ["date", "series_id"]).isEmpty():
        raise ValueError("duplicate (date, series_id): name a frequency or version")
    return long.groupBy("date").pivot("series_id", list(ids)).agg(F.first("value"))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] = ("value", "loaded_at")) -> DataFrame:
    """Upsert: new keys come in whole, known keys take only `update` from new; the rest of their metadata survives."""
    o, n = old.alias("o"), new.alias("n")
    known = F.coalesce(*(F.col(f"o.{k}").isNotNull() for k in keys[:1]))
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    return joined.select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in update else F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, mark): 12 hexadecimal digits of the content that don't depend on row order: the sum of the rows' SHA-256
    heads (48 bits), so repeated rows count. Numbers with fractions enter with six decimals, null as a mark of its own."""
    text = lambda c, kind: F.col(c).cast("decimal(38,6)").cast("string") if kind in ("double", "float") else F.col(c).cast("string")
    line = F.concat_ws("|", *(F.coalesce(text(c, kind), F.lit("\\N")) for c, kind in df.dtypes))
    head = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(head), F.lit(0).cast("decimal(38,0)")) % F.lit(1 << 48).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.lower(F.lpad(F.hex(total.cast("long")), 12, "0")).alias("mark"))


def save_version(df: DataFrame, path: str, tag: str) -> None:
    """Writes under a path that names the version; an existing version is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{path}/version={tag}")


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def version_tag(mark: str, orders: Sequence[int]) -> str:
    return f"{mark}_ar{'-'.join(map(str, orders))}"


def latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
