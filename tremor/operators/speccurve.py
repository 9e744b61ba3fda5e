"""Specification curves with block-bootstrap inference: draws, fits and statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.dist import norm_ppf, normal_p

from .detect import draw
from .quantiles import exact, sandwich
from .transforms import require


def block_indices(spark, n: int, block: int, draws: int, seed: int = 1) -> DataFrame:
    """(b, pos, source): moving-block bootstrap of n rows: block starts uniform in [0, n - block], cut at n."""
    if not 1 <= block <= n:
        raise ValueError(f"block length {block} isn't in 1 .. {n}")
    many = -(-n // block)
    starts = spark.range(draws * many).select((F.col("id") / many).cast("long").alias("b"), (F.col("id") % many).alias("k"))
    starts = starts.withColumn("start", draw(seed, F.col("b"), F.col("k"), below=F.lit(n - block + 1)))
    each = starts.select("b", F.col("k"), "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"))
    return each.select("b", (F.col("k") * block + F.col("j")).alias("pos"), (F.col("start") + F.col("j")).alias("source")).where(F.col("pos") < n)


def sign_share(coef: Column) -> tuple[Column, Column]:
    """Aggregates: the dominant sign (ties: +1) and its share."""
    up = F.avg((coef > 0).cast("int"))
    down = F.avg((coef < 0).cast("int"))
    return F.when(up >= down, 1).otherwise(-1), F.greatest(up, down)


def stouffer(p: Column, coef: Column) -> Column:
    """Sum of normal scores with the sign of their own coefficient over the root of their number; p is two-sided, clipped to
    [1e-12, 1 - 1e-12]."""
    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return F.sum(norm_ppf(1 - clipped / 2) * F.signum(coef)) / F.sqrt(F.count(p))


def statistics(fits: DataFrame, keys: Sequence[str], alpha: float = 0.05, sign: float | None = None) -> DataFrame:
    """keys, median, share, stouffer over the specifications (coef, p): share is significant in the target direction, which
    is `sign` or else the dominant sign."""
    if sign is None:
        mark, _ = sign_share(F.col("coef"))
        fits = fits.join(fits.groupBy(*keys).agg(mark.alias("_s")), list(keys))
    else:
        fits = fits.withColumn("_s", F.lit(sign))
    hit = (F.col("p") < alpha) & (F.signum("coef") == F.col("_s"))
    return fits.groupBy(*keys).agg(F.percentile("coef", F.lit(0.5)).alias("median"), F.avg(hit.cast("int")).alias("share"), stouffer(F.col("p"), F.col("coef")).alias("stouffer"))


MOST = 16_000_000  # numbers of a panel that a task holds (128 MB); its rows are days, so a larger one is a mistake


def _fit_all(specs: list[dict], names: list[str]):
    """fits(y, x, tags) of all specifications on one outcome: [(spec_id, coef, se, p, n)]. Rows of a specification are those of
    its sample that have all its columns. Specifications with the same rows share one matrix of cross products, of which each
    reads its own part; the outcome only enters by its products with the columns."""
    at = {c: k for k, c in enumerate(names)}
    known: dict = {}

    def subsets(x: np.ndarray, tags: np.ndarray, tag_at: dict[str, int]) -> list:
        groups: dict[bytes, list] = {}
        for s in specs:
            cols = [at[s["shock"]], *(at[c] for c in s["controls"])]
            mask = ~np.isnan(x[:, cols]).any(axis=1)
            if s["sample"]:
                mask &= tags[:, tag_at[s["sample"]]]
            groups.setdefault(mask.tobytes(), []).append((s, cols))
        out = []
        for key, members in groups.items():
            rows = np.flatnonzero(np.frombuffer(key, bool))
            used = sorted({c for _, cols in members for c in cols})
            part = x[np.ix_(rows, used)]
            centred = part - part.mean(axis=0) if len(rows) else part
            out.append((rows, {c: k for k, c in enumerate(used)}, part, centred, centred.T @ centred, members))
        return out

    def fits(y: np.ndarray, x: np.ndarray, tags: np.ndarray, tag_at: dict[str, int]) -> list[tuple]:
        if not known:
            known["subsets"] = subsets(x, tags, tag_at)
        out = []
        for rows, place, part, centred, gram, members in known["subsets"]:
            mine = y[rows]
            less = mine - mine.mean() if len(mine) else mine
            products, total = centred.T @ less, float(less @ less)
            for s, cols in members:
                k = [place[c] for c in cols]
                n, dof = len(rows), len(rows) - len(k) - 1
                if dof <= 0:
                    continue
                if s["funcform"] == "ols":
                    inverse = np.linalg.pinv(gram[np.ix_(k, k)], hermitian=True)
                    beta = inverse @ products[k]
                    coef, se = float(beta[0]), float(np.sqrt(max(inverse[0, 0] * (total - beta @ products[k]) / dof, 0.0)))
                else:
                    tau = float(s["funcform"].removeprefix("quantile "))
                    data = np.c_[np.ones(n), part[:, k]]
                    b = exact(data, mine, tau)
                    coef, se = float(b[1]), float(sandwich(data, mine, b, tau)[1])
                out.append((s["spec_id"], coef, se, normal_p(coef / se) if se > 0 else None, n))
        return out

    return fits


def fit_specs(panel: DataFrame, specs: DataFrame, block: int = 1, draws: int = 0, seed: int = 1) -> DataFrame:
    """(b, spec_id, coef, se, p, n): every specification's effect, for b = -1 on the panel as it is, for b = 0 .. draws - 1 with
    the outcome moved in blocks over all its rows and everything else left in place, so on the same rows as observed.

    panel: pos (0 .. n - 1), y (never null), columns and boolean sample tags. specs: spec_id, shock (a column), controls (array of
    columns), funcform ('ols', with classical errors, or 'quantile <tau>', with sandwich errors), sample (a tag, or null for all
    rows). p-values are normal. Specifications with too few rows give no row. Draws are dealt out to tasks, each of which holds
    the whole panel; its size is checked first. The specifications come to the driver.
    """
    spark = panel.sparkSession
    rows = [r.asDict() for r in specs.select("spec_id", "shock", "controls", "funcform", "sample").collect()]
    for r in rows:
        r["controls"] = list(r["controls"] or [])
        if r["funcform"] != "ols" and not 0 < float(r["funcform"].removeprefix("quantile ")) < 1:
            raise ValueError(f"no such functional form: {r['funcform']}")
    names = list(dict.fromkeys(c for r in rows for c in (r["shock"], *r["controls"])))
    tag_names = list(dict.fromkeys(r["sample"] for r in rows if r["sample"]))
    require(panel, ["pos", "y", *names, *tag_names])
    n = panel.count()
    if n * (len(names) + 2) > MOST:
        raise ValueError(f"a panel of {n} rows and {len(names)} columns doesn't fit a task")
    if draws and not 1 <= block <= n:
        raise ValueError(f"block length {block} isn't in 1 .. {n}")
    many = -(-n // block)
    line = F.struct(F.col("pos").cast("long").alias("pos"), F.col("y").cast("double").alias("y"), F.array(*(F.col(c).cast("double") for c in names)).alias("x"), F.array(*(F.coalesce(F.col(c), F.lit(False)) for c in tag_names)).cast("array<boolean>").alias("tags"))
    whole = panel.agg(F.sort_array(F.collect_list(line)).alias("rows"))
    starts = F.when(F.col("b") >= 0, F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda k: draw(seed, F.col("b"), k, below=F.lit(n - block + 1))))
    each = spark.range(-1, draws).select(F.col("id").alias("b")).repartition(max(1, min(draws // 16, spark.sparkContext.defaultParallelism * 4))).select("b", starts.alias("starts"))
    packed = whole.select(F.col("rows.y").alias("y"), F.flatten("rows.x").alias("x"), F.flatten("rows.tags").alias("tags"))
    tag_at = {c: k for k, c in enumerate(tag_names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = _fit_all(rows, names)
        held = None
        for batch in batches:
            for k, (b, start) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if held is None:  # the same in every row
                    cell = lambda c: batch.column(c)[k].values  # noqa: B023, E731
                    held = cell(2).to_numpy(zero_copy_only=False), cell(3).to_numpy(zero_copy_only=False).astype(float).reshape(n, len(names)), cell(4).to_numpy(zero_copy_only=False).astype(bool).reshape(n, len(tag_names))
                y = held[0] if start is None else held[0][(np.array(start)[:, None] + np.arange(block)).ravel()[:n]]
                found = [(b, *f) for f in fits(y, held[1], held[2], tag_at)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _FIT.types, strict=True)], _FIT.names) if found else pa.RecordBatch.from_pylist([], _FIT)

    if not n:
        return spark.createDataFrame([], "b long, spec_id string, coef double, se double, p double, n long")
    return each.crossJoin(F.broadcast(packed)).mapInArrow(run, "b long, spec_id string, coef double, se double, p double, n long")  # one row of arrays


_FIT = pa.schema([("b", pa.int64()), ("spec_id", pa.string()), ("coef", pa.float64()), ("se", pa.float64()), ("p", pa.float64()), ("n", pa.int64())])


def curve(fits: DataFrame, alpha: float = 0.05, sign: float | None = None) -> DataFrame:
    """One row of observed statistics with bootstrap p-values under no effect, from the fits of `fit_specs`.

    p-values are two-sided for the median and Stouffer's Z, one-sided for the share; a `sign` sets the direction in which a
    specification counts as significant.
    """
    stats = statistics(fits, ["b"], alpha, sign)
    o = stats.where("b = -1").select(F.col("median").alias("m"), F.col("share").alias("s"), F.col("stouffer").alias("z"))
    both = stats.where("b >= 0").crossJoin(F.broadcast(o))  # one row of observed statistics
    share = lambda c: F.avg(c.cast("int"))
    return both.groupBy("m", "s", "z").agg(share(F.abs("median") >= F.abs("m")).alias("p_median"), share(F.col("share") >= F.col("s")).alias("p_share"), share(F.abs("stouffer") >= F.abs("z")).alias("p_stouffer"), F.count("*").alias("draws")).select(F.col("m").alias("median"), F.col("s").alias("share"), F.col("z").alias("stouffer"), "p_median", "p_share", "p_stouffer", "draws")


def grid(spark, levels: dict[str, Sequence], needs_jump: str = "threshold") -> DataFrame:
    """All combinations of specification levels; a threshold goes only with a shock that has a JUMP part. A level may be a
    list of columns, such as controls."""
    from itertools import product

    kinds = ", ".join(f"{name} {'array<string>' if values and isinstance(values[0], list | tuple) else 'string'}" for name, values in levels.items())
    out = spark.createDataFrame(list(product(*levels.values())), kinds)
    return out.where((F.col(needs_jump) == "none") | F.col("shock").contains("JUMP")) if needs_jump in levels else out


def rejection(samples: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(block, rate, n) of p-values per block length, and nearest: is it the one closest to alpha."""
    per = samples.groupBy("block").agg(F.avg((F.col("p") < alpha).cast("int")).alias("rate"), F.count("*").alias("n"))
    w = Window.orderBy(F.abs(F.col("rate") - alpha), "block")
    return per.withColumn("nearest", F.row_number().over(w) == 1)
