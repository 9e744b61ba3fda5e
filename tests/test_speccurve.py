"""Specifications as rows of a grid against numpy, the null curve's rows, and exact quantile fits against linear programs."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions import dist
from tremor.operators import inference, quantiles, speccurve

KINDS = "pos long, y double, x double, z double, c double, d double, early boolean"


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(3)
    n = 90
    v = draw.standard_normal((n, 5))
    v[:, 0] += 0.7 * v[:, 1] - 0.4 * v[:, 3]
    rows = [(k, *map(float, v[k]), k < 50 if k % 9 else None) for k in range(n)]
    rows = [tuple(None if c == 3 and r[0] % 7 == 0 else x for c, x in enumerate(r)) for r in rows]  # z has gaps
    return rows, spark.createDataFrame(rows, KINDS).repartition(3)


def plain(rows, y, shock, controls, form, sample):
    at = {"x": 2, "z": 3, "c": 4, "d": 5}
    cols = [at[shock], *(at[c] for c in controls)]
    keep = [r for r in rows if all(r[c] is not None for c in cols) and (not sample or r[6])]
    x = np.array([[1.0, *(r[c] for c in cols)] for r in keep])
    mine = np.array([y[r[0]] for r in keep])
    if form == "ols":
        b = np.linalg.solve(x.T @ x, x.T @ mine)
        e = mine - x @ b
        return b[1], np.sqrt(np.linalg.inv(x.T @ x)[1, 1] * (e @ e) / (len(x) - x.shape[1])), len(x)
    b = quantiles.exact(x, mine, float(form.split()[1]))
    return b[1], quantiles.sandwich(x, mine, b, float(form.split()[1]))[1], len(x)


def test_grid_rows_drive_the_fits_and_nulls_keep_the_rows(spark, panel):
    rows, df = panel
    levels = speccurve.grid(spark, {"shock": ["x", "z"], "controls": [["c", "d"], ["c"], []], "funcform": ["ols", "quantile 0.25"], "sample": ["", "early"]})
    specs = levels.select(F.concat_ws("/", "shock", F.concat_ws("+", "controls"), "funcform", "sample").alias("spec_id"), "shock", "controls", "funcform", F.nullif("sample", F.lit("")).alias("sample"))
    got = speccurve.fit_specs(df, specs, 10, 6, seed=2).collect()
    assert len(got) == 24 * 7
    moved = {(r.b, r.pos): r.source for r in speccurve.block_indices(spark, 90, 10, 6, 2).collect()}
    for r in got:
        shock, controls, form, sample = r.spec_id.split("/")
        y = [rows[k if r.b < 0 else moved[r.b, k]][1] for k in range(90)]
        coef, se, n = plain(rows, y, shock, controls.split("+") if controls else [], form, sample)
        assert (r.coef, r.se, r.n) == (pytest.approx(coef, abs=1e-9), pytest.approx(se, rel=1e-6), n)
        assert r.p == pytest.approx(dist.normal_p(coef / se), abs=1e-9)
    observed = {r.spec_id: r.n for r in got if r.b < 0}
    assert all(r.n == observed[r.spec_id] for r in got)


def test_curve_finds_an_effect(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((150, 2))
    x[:, 1] = x[:, 0] + 0.1 * x[:, 1]
    specs = spark.createDataFrame([("a", "x", None, "ols", None), ("b", "z", [], "ols", None)], "spec_id string, shock string, controls array<string>, funcform string, sample string")
    for effect, low in ((0.6, True), (0.0, False)):
        y = effect * x[:, 0] + draw.standard_normal(150)
        df = spark.createDataFrame([(k, float(y[k]), *map(float, x[k])) for k in range(150)], "pos long, y double, x double, z double")
        (r,) = speccurve.curve(speccurve.fit_specs(df, specs, 10, 40)).collect()
        assert (r.p_median <= 0.05) == low and r.draws == 40


def test_guards(spark, panel, monkeypatch):
    _, df = panel
    one = lambda *s: spark.createDataFrame([s], "spec_id string, shock string, controls array<string>, funcform string, sample string")
    with pytest.raises(Exception, match="nothing"):
        speccurve.fit_specs(df, one("a", "nothing", [], "ols", None))
    for form in ("quantile 1.0", "probit"):
        with pytest.raises(ValueError):
            speccurve.fit_specs(df, one("a", "x", [], form, None))
    with pytest.raises(ValueError):
        speccurve.fit_specs(df, one("a", "x", [], "ols", None), 91, 5)
    assert speccurve.fit_specs(df.where("pos < 2"), one("a", "x", [], "ols", None)).count() == 0
    assert speccurve.fit_specs(df.limit(0), one("a", "x", [], "ols", None)).count() == 0
    monkeypatch.setattr(speccurve, "MOST", 100)
    with pytest.raises(ValueError):
        speccurve.fit_specs(df, one("a", "x", [], "ols", None))
    got = {(r.shock, r.threshold) for r in speccurve.grid(spark, {"shock": ["LEVEL", "JUMP"], "threshold": ["none", "q95"]}).collect()}
    assert got == {("LEVEL", "none"), ("JUMP", "none"), ("JUMP", "q95")}


def test_rejection_names_the_nearest_block(spark):
    rows = [(10, 0.01)] * 3 + [(10, 0.5)] * 7 + [(20, 0.04)] + [(20, 0.9)] * 19
    got = {r.block: r for r in speccurve.rejection(spark.createDataFrame(rows, "block int, p double")).collect()}
    assert got[10].rate == pytest.approx(0.3) and got[20].rate == pytest.approx(0.05) and got[20].nearest and not got[10].nearest


def loss(x, y, b, tau):
    r = y - x @ b
    return float(np.where(r >= 0, tau, tau - 1) @ r)


def test_exact_quantile_fits_are_linear_programs():
    """The optimum of the linear program lies at a plane through k rows: all of them are tried."""
    draw = np.random.default_rng(0)
    for trial in range(120):
        n, k, tau = int(draw.integers(4, 14)), int(draw.integers(1, 4)), draw.uniform(0.05, 0.95)
        x = np.c_[np.ones(n), draw.normal(size=(n, k - 1)) * 10.0 ** draw.integers(-2, 3)]
        y = np.round(draw.normal(size=n), 0 if trial % 3 == 0 else 8)
        best = min(loss(x, y, np.linalg.solve(x[list(c)], y[list(c)]), tau) for c in combinations(range(n), k) if abs(np.linalg.det(x[list(c)])) > 1e-9)
        assert loss(x, y, quantiles.exact(x, y, tau), tau) <= best + 1e-8 * (1 + abs(best))
    x = np.c_[np.ones(30), np.arange(30.0), 2 * np.arange(30.0)]  # a column that depends on another
    b = quantiles.exact(x, 3 + x[:, 1], 0.3)
    assert np.allclose(x @ b, 3 + x[:, 1])


def errors(x, y, b, tau):
    """The sandwich by plain loops."""
    e = [float(v) for v in y - x @ b]
    n = len(e)
    z = dist.ppf(tau)
    f = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    h = n ** (-1 / 3) * dist.ppf(0.975) ** (2 / 3) * (1.5 * f * f / (2 * z * z + 1)) ** (1 / 3)
    at = lambda q: float(np.percentile(e, q))
    h = min(float(np.std(y)), (at(75) - at(25)) / 1.34) * (dist.ppf(tau + h) - dist.ppf(tau - h))
    density = sum(0.75 * (1 - (v / h) ** 2) for v in e if abs(v) <= h) / (n * h)
    meat = sum(np.outer(r, r) * ((tau / density) ** 2 if v > 1e-9 * np.std(y) else ((1 - tau) / density) ** 2) for r, v in zip(x, e, strict=True))
    inverse = np.linalg.inv(x.T @ x)
    return np.sqrt(np.diag(inverse @ meat @ inverse))


@pytest.mark.parametrize("band", [4000, 60])
def test_grouped_quantile_fits(spark, band):
    """A small band makes most rows enter as sums; the planes stay those of all rows."""
    draw = random.Random(2)
    rows = [("m", k * 0.1, draw.gauss(0, 1), 2.0 + 0.05 * k + (draw.expovariate(1) * 40 if k % 5 == 0 else draw.gauss(0, 0.5))) for k in range(900)]
    rows += [("n", draw.gauss(0, 1), draw.gauss(0, 3), draw.gauss(0, 1)) for _ in range(300)] + [("few", 1.0, 2.0, 3.0)] * 2 + [("m", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, x double, w double, y double").repartition(3)
    got = {r.model: r for r in quantiles.quantile_fit(df, ["model"], "y", ["x", "w"], 0.4, band=band).collect()}
    assert got.keys() == {"m", "n"}
    for name in "mn":
        x, y = np.array([[1.0, a, b] for m, a, b, _ in rows if m == name and a is not None]), np.array([c for m, a, _, c in rows if m == name and a is not None])
        b = np.array([got[name].intercept, *got[name].beta])
        assert loss(x, y, b, 0.4) == pytest.approx(loss(x, y, quantiles.exact(x, y, 0.4), 0.4), rel=1e-9)
        assert got[name].n == len(y) and np.allclose(got[name].se, errors(x, y, b, 0.4)[1:], rtol=1e-6)
    with pytest.raises(ValueError):
        quantiles.quantile_fit(df, ["model"], "y", ["x"], 1.0)


def test_quantile_projection_has_student_p_values(spark):
    draw = random.Random(6)
    rows = [("p", t, draw.gauss(0, 1), draw.gauss(0, 1)) for t in range(120)]
    df = spark.createDataFrame(rows, "panel_id string, t int, y double, x double")
    for r in inference.quantile_projection(df, ["panel_id"], "y", "x", (), [0, 2], 0.5).collect():
        x = np.array([[1.0, rows[t][3]] for t in range(120 - r.horizon)])
        y = np.array([rows[t + r.horizon][2] for t in range(120 - r.horizon)])
        b = quantiles.exact(x, y, 0.5)
        assert r.nobs == len(y) and r.beta == pytest.approx(b[1]) and r.se == pytest.approx(errors(x, y, b, 0.5)[1])
        assert r.p == pytest.approx(dist.t_p(r.beta / r.se, len(y) - 2))
