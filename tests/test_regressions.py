"""Estimators against numpy, identities and invariances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions import dist
from tremor.operators import detect, gram, indices, inference, response, speccurve


@pytest.fixture(scope="module")
def panel(spark):
    draw = np.random.default_rng(5)
    n = 240
    shock = draw.standard_normal(n)
    ctrl = 0.5 * shock + draw.standard_normal(n)
    y = np.convolve(shock, [1, 0.6, 0.3])[:n] + 0.4 * ctrl + draw.standard_normal(n)
    rows = [("p", k, float(shock[k]), float(ctrl[k]), float(y[k])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "panel_id string, t int, shock double, ctrl double, y double")


def ols(x, y):
    x = np.c_[np.ones(len(x)), x]
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    return x, inv, beta, y - x @ beta


def hac(x, inv, e, lags):
    u = x * e[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    return inv @ s @ inv


def test_local_projection_equals_the_matrix_form(panel):
    rows, df = panel
    a = np.array([r[2:] for r in rows])
    for kind, lags in (("hac", 0), ("lag_augmented", 2)):
        got = {r.horizon: r for r in gram.local_projection(df, ["panel_id"], "y", "shock", ["ctrl"], [0, 1, 3], kind=kind, lags=lags).collect()}
        for h in (0, 1, 3):
            x, y = a[:, :2], a[:, 2]
            if kind == "lag_augmented":
                x = np.c_[x[2:], y[1:-1], y[:-2], a[1:-1, 0], a[:-2, 0]]
                y = y[2:]
            x, y = (x[: len(x) - h], y[h:]) if h else (x, y)
            full, inv, beta, e = ols(x, y)
            n, k = full.shape
            v = hac(full, inv, e, max(3, h)) if kind == "hac" else n / (n - k) * inv @ (full * e[:, None]).T @ (full * e[:, None]) @ inv
            assert got[h].nobs == n
            assert got[h].beta == pytest.approx(beta[1], abs=1e-9) and got[h].se == pytest.approx(np.sqrt(v[1, 1]), abs=1e-9)
            assert got[h].p == pytest.approx(dist.normal_p(beta[1] / np.sqrt(v[1, 1])), abs=1e-9)
    with pytest.raises(ValueError):
        gram.local_projection(df, ["panel_id"], "y", "shock", kind="lag_augmented")


def test_too_few_rows_give_no_estimate(spark):
    df = spark.createDataFrame([("p", k, float(k), float(k * k)) for k in range(4)], "panel_id string, t int, x double, y double")
    got = [r.horizon for r in gram.local_projection(df, ["panel_id"], "y", "x", (), [0, 1, 2, 3]).collect()]
    assert sorted(got) == [0, 1]


def test_shapley_sums_to_r2(panel):
    rows, df = panel
    got = gram.shapley_r2(df.withColumn("c", F.col("shock") * F.col("ctrl")), ["panel_id"], "y", ["shock", "ctrl"], ["c"]).collect()
    assert sum(r.share for r in got) == pytest.approx(got[0].r2_full - got[0].r2_base, abs=1e-9)
    with pytest.raises(ValueError):
        gram.shapley_r2(df, ["panel_id"], "y", ["shock"] * 16)


def test_block_granger(spark):
    draw = np.random.default_rng(2)
    n = 400
    z, x = draw.standard_normal(n), draw.standard_normal(n)
    dependent = x.copy()
    dependent[1:] += 0.8 * z[:-1]
    for series, low in ((x, False), (dependent, True)):
        df = spark.createDataFrame([("s", k, float(series[k]), float(z[k])) for k in range(n)], "series_id string, t int, x double, z double")
        (r,) = gram.block_granger(df, ["x"], ["z"], 2).collect()
        assert (r.p < 0.001) == low and r.q == 2 and r.dof == n - 2 - 5


def test_distributions():
    assert dist.ppf(0.95) == pytest.approx(1.6448536, abs=1e-6)
    assert dist.t_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.f_p(3.3258, 5, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.f_p(0.0, 5, 10) == 1.0 and dist.t_p(0.0, 3) == pytest.approx(1.0)


@pytest.mark.parametrize("kind, lags", [("hac", 0), ("lag_augmented", 2)])
def test_sup_t_is_wider_than_pointwise(panel, kind, lags):
    _, df = panel
    band = lambda hs: inference.sup_t(df, ["panel_id"], "y", "shock", ["ctrl"], hs, kind, lags).collect()
    (one,) = {r.critical for r in band([0])}
    many = band([0, 1, 2, 3])
    (wide,) = {r.critical for r in many}
    assert one == pytest.approx(1.6448536, abs=1e-6) and one < wide < 2.6
    irf = {r.horizon: r for r in gram.local_projection(df, ["panel_id"], "y", "shock", ["ctrl"], [0, 1, 2, 3], kind, lags=lags).collect()}
    for r in many:
        assert (r.beta, r.se) == (pytest.approx(irf[r.horizon].beta), pytest.approx(irf[r.horizon].se))
        assert r.hi - r.lo == pytest.approx(2 * wide * r.se)


def test_stouffer_takes_each_coefficients_own_sign(spark):
    draw = random.Random(17)
    fits = [(k % 3, draw.gauss(-0.5, 1), draw.uniform(1e-4, 1)) for k in range(60)]
    got = {r.g: r for r in speccurve.statistics(spark.createDataFrame(fits, "g int, coef double, p double"), ["g"]).collect()}
    for g in range(3):
        mine = [(c, p) for k, c, p in fits if k == g]
        assert got[g].stouffer == pytest.approx(sum(dist.ppf(1 - p / 2) * (1 if c > 0 else -1) for c, p in mine) / len(mine) ** 0.5, abs=1e-6)
        down = sum(c < 0 for c, _ in mine) > len(mine) / 2
        assert got[g].share == pytest.approx(sum(p < 0.05 and (c < 0) == down for c, p in mine) / len(mine))


def test_convolution_equals_a_double_loop(spark):
    draw = random.Random(31)
    channels, steps, last = ["c1", "c2", "c3"], 5, 6
    gamma, theta = ({(c, h): draw.gauss(0, 1) for c in channels for h in range(steps) if draw.random() < 0.8} for _ in range(2))
    make = lambda x: spark.createDataFrame([(c, h, v) for (c, h), v in x.items()], "channel string, horizon int, beta double")
    indirect = response.convolve(make(gamma), make(theta), last)
    got = {(r.channel, r.horizon): r.indirect for r in indirect.collect()}
    want = {}
    for c in channels:
        for s in range(steps):
            for u in range(steps):
                if s + u <= last and (c, s) in gamma and (c, u) in theta:
                    for name in (c, None):
                        want[name, s + u] = want.get((name, s + u), 0) + gamma[c, s] * theta[c, u]
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    direct = {h: draw.gauss(0, 1) for h in range(3)}
    table = spark.createDataFrame(list(direct.items()), "horizon int, beta double")
    for r in response.transmission(indirect, table, table).collect():
        assert r.total == pytest.approx(direct.get(r.horizon, 0) + want[None, r.horizon]) and r.domestic == direct.get(r.horizon)


def test_auc(spark):
    draw = random.Random(7)
    rows = [("m", float(draw.randint(0, 9)), draw.random() < 0.3) for _ in range(200)]
    df = spark.createDataFrame(rows, "measure string, value double, is_event boolean")
    e, c = [v for _, v, x in rows if x], [v for _, v, x in rows if not x]
    want = sum((a > b) + 0.5 * (a == b) for a in e for b in c) / len(e) / len(c)
    one = lambda d: detect.auc(d, ["measure"]).first().auc
    assert one(df) == pytest.approx(want)
    assert one(df.withColumn("value", F.exp("value"))) == pytest.approx(want)
    assert one(df.withColumn("value", F.when(F.col("is_event"), 99.0).otherwise(F.col("value")))) == 1.0
    assert one(df.where("not is_event").union(df.where("is_event").limit(2))) is None


def test_auc_interval_equals_resampled_years(spark):
    draw = random.Random(9)
    rows = [(s, f"{y}-0{1 + k % 9}-01", float(draw.randint(0, 6)) if draw.random() < 0.9 else None, draw.random() < 0.3) for s in "ab" for y in (2001, 2002, 2003, 2004) for k in range(25)]
    rows += [("few", "2001-01-01", 1.0, True), ("few", "2002-01-01", 2.0, False)]
    df = spark.createDataFrame(rows, "measure string, day string, value double, is_event boolean").withColumn("date", F.to_date("day"))
    got = {r.measure: r for r in detect.auc_interval(df, ["measure"], draws=150, seed=4).collect()}
    picks = lambda b, n: [detect_draw(4, b, k) % n for k in range(n)]
    for s in "ab":
        years, values = [2001, 2002, 2003, 2004], []
        for b in range(150):
            e, c = [], []
            for y in (years[i] for i in picks(b, 4)):
                for m, d, v, x in rows:
                    if m == s and v is not None and d.startswith(str(y)):
                        (e if x else c).append(v)
            if min(len(e), len(c)) >= 3:
                values.append(sum((p > q) + 0.5 * (p == q) for p in e for q in c) / len(e) / len(c))
        assert got[s].n_draws == len(values)
        assert (got[s].lo, got[s].hi) == (pytest.approx(np.percentile(values, 2.5)), pytest.approx(np.percentile(values, 97.5)))
    assert got["few"].n_draws == 0 and got["few"].lo is None


def detect_draw(seed, *parts):
    x = seed % 1000003
    for p in parts:
        x = (x * 7919 + p * 104729 + 12345) % 1000003
        x = (x * x + x * 31 + 7) % 1000003
    return x


def test_block_bootstrap(spark):
    with pytest.raises(ValueError):
        speccurve.block_indices(spark, 10, 11, 2)
    rows = speccurve.block_indices(spark, 25, 10, 30).collect()
    assert len(rows) == 25 * 30 and {r.source for r in rows} <= set(range(25))
    by = {(r.b, r.pos): r.source for r in rows}
    assert all(by[b, p + 1] == by[b, p] + 1 for b, p in by if (p + 1) % 10 and (b, p + 1) in by)
    assert rows == speccurve.block_indices(spark, 25, 10, 30).collect()
    assert len({by[b, 0] for b in range(30)}) > 8


def test_neighbours_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    m = draw.standard_normal((120, 8))
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in indices.neighbours(df, df.where("vec_id % 20 = 0"), 3, blocks=7).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 120, 20):
        s = unit @ unit[q]
        s[q] = -2
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-s)[:3].tolist()


def test_holm(spark):
    df = spark.createDataFrame([("g", "a", 0.01), ("g", "b", 0.04), ("g", "c", 0.03)], "grp string, name string, p double")
    got = {r.name: r.p_holm for r in indices.holm(df, "grp").collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_neighbours_in_bounded_groups(spark, monkeypatch):
    """Vectors dealt to more blocks and queries to chunks give the result of one group."""
    draw = np.random.default_rng(8)
    df = spark.createDataFrame([(k, draw.standard_normal(6).tolist()) for k in range(300)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 3 = 0")
    want = sorted(map(tuple, indices.neighbours(df, queries, 3, blocks=1).select("query_id", "rank", "vec_id").collect()))
    monkeypatch.setattr(indices, "BLOCK", 60)
    monkeypatch.setattr(indices, "CHUNK", 25)
    near = indices.neighbours(df, queries, 3, blocks=1)
    assert sorted(map(tuple, near.select("query_id", "rank", "vec_id").collect())) == want
    assert near.groupBy("query_id").count().where("count = 3").count() == 100
