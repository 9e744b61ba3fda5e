"""Nearest analogues against brute force, with distance in time before the cut, and the paths that followed."""

import numpy as np
import pytest

from tremor.operators import analogues, indices
from tremor.streaming import live

KINDS = "id long, at long, vector array<double>"


@pytest.mark.parametrize(("apart", "past"), [(0, False), (15, False), (15, True)])
def test_nearest_equals_brute_force(spark, monkeypatch, apart, past):
    monkeypatch.setattr(analogues, "ROWS", 50)
    monkeypatch.setattr(analogues, "QUERIES", 12)
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((6, 5))
    m = np.concatenate([centres[draw.integers(0, 6, 260)] + 0.3 * draw.standard_normal((260, 5)), np.tile(centres[0], (140, 1))])  # a third are copies
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(k, k // 2, m[k].tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    got = {}
    for r in analogues.nearest(df, df.where("id % 20 = 0"), 7, apart, past).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.cosine))
    cos = m @ m.T
    for q in range(0, 400, 20):
        ok = [k for k in range(400) if k != q and abs(k // 2 - q // 2) > apart and (not past or k // 2 < q // 2)]
        best = sorted(ok, key=lambda k: -cos[q, k])[:7]
        mine = sorted(got.get(q, []))
        assert [c for *_, c in mine] == pytest.approx([cos[q, k] for k in best], abs=1e-9)
        assert {k for _, k, _ in mine} <= set(ok) and len({k for _, k, _ in mine}) == len(best)
    assert analogues.nearest(df.limit(0), df, 3).count() == 0 and analogues.nearest(df, df.limit(0), 3).count() == 0


def test_standardised_vectors(spark):
    rows = [(1, 1.0, 5.0, None), (2, 3.0, 5.0, 1.0), (3, 5.0, 5.0, 2.0), (4, None, 5.0, 3.0)]
    out = analogues.standardised(spark.createDataFrame(rows, "id long, a double, flat double, other double"), ["a", "flat"]).collect()
    assert {r.id: r.vector for r in out} == {1: [-1.0, 0.0], 3: [1.0, 0.0]}  # the mean row has no direction


def test_paths_are_silent_on_few_and_tell_dispersion(spark):
    found = spark.createDataFrame([(1, k) for k in range(4)] + [(2, k) for k in range(6)] + [(3, k) for k in range(10, 16)], "query_id long, id long")
    values = [(k, 5, float(k + 1)) for k in range(6)] + [(10 + k, 5, float((-1) ** k * (k + 1))) for k in range(6)] + [(0, 9, None)]
    got = {r.query_id: r for r in analogues.paths(found, spark.createDataFrame(values, "id long, horizon int, value double")).collect()}
    assert (got[1].n, got[1].median, got[1].verdict) == (4, None, "silent")
    assert (got[2].median, got[2].same_sign, got[2].verdict) == (3.5, 1.0, "clear") and got[3].verdict == "dispersed"


def test_ordinal_agreement_equals_the_coincidence_matrix(spark):
    draw = np.random.default_rng(1)
    rows = [(int(u), int(min(max(u % 5 + draw.integers(-1, 2), 0), 4))) for u in draw.integers(0, 40, 160)] + [(99, 3), (100, None)]
    (r,) = indices.ordinal_agreement(spark.createDataFrame(rows, "unit int, rating int")).collect()
    units = {}
    for u, v in rows:
        if v is not None:
            units.setdefault(u, []).append(v)
    units = {u: v for u, v in units.items() if len(v) > 1}
    o = np.zeros((5, 5))
    for v in units.values():
        for i, a in enumerate(v):
            for j, b in enumerate(v):
                if i != j:
                    o[a, b] += 1 / (len(v) - 1)
    n = o.sum(axis=1)
    d = np.array([[(n[min(a, b) : max(a, b) + 1].sum() - (n[a] + n[b]) / 2) ** 2 for b in range(5)] for a in range(5)])
    assert r.alpha == pytest.approx(1 - (o * d).sum() / ((np.outer(n, n) * d).sum() / (n.sum() - 1)))


def test_histograms_of_parts_add_up(spark):
    rows = [("a", float(k % 13)) for k in range(60)] + [("b", -1.0), ("b", 99.0), ("b", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    whole = live.histogram(df, "key", "v", 1.0, 8)
    parts = live.histogram(df.where("v < 5 or key = 'b'"), "key", "v", 1.0, 8).unionByName(live.histogram(df.where("v >= 5 and key = 'a'"), "key", "v", 1.0, 8))
    show = lambda d: {r.key: r.counts for r in d.collect()}
    assert show(whole) == show(live.merged_histograms(parts, "key", 8)) and show(whole)["b"] == [1, 0, 0, 0, 0, 0, 0, 1]
    got = {(r.key, r.v): r.percentile for r in live.percentile_since(df.union(spark.createDataFrame([("new", 1.0)], df.schema)), whole, "key", "v", 1.0).collect()}
    assert got["a", 0.0] == pytest.approx(100 * show(whole)["a"][0] / 60) and got["b", 99.0] == 100.0 and got["new", 1.0] is None
