"""Golden cases of transforms, stores and temporal joins."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import timealign, transforms
from tremor.operators import windows as W
from tremor.sources import store

D = dt.date.fromisoformat


def long(spark, values, first="2024-01-05", name="a"):
    day = D(first)
    return spark.createDataFrame([(name, day + dt.timedelta(k), v) for k, v in enumerate(values)], "series_id string, date date, value double")


def column(df, *by):
    return [r[0] for r in df.orderBy(*by).collect()]


def test_log_return_and_gap(spark):
    draw = random.Random(41)
    values = [draw.uniform(3, 900) for _ in range(12)]
    for k in (4, 5, 9):
        values[k] = None
    df = long(spark, values)
    got = column(df.select(transforms.dlog(F.col("value")), "date"), "date")
    assert got == [None if k == 0 or values[k] is None or values[k - 1] is None else pytest.approx(math.log(values[k]) - math.log(values[k - 1])) for k in range(12)]
    dense = [v for v in values if v is not None]
    assert [r.value for r in transforms.dlog_dense(df).orderBy("date").collect()] == pytest.approx([math.log(y / x) for x, y in zip(dense, dense[1:], strict=False)])


def test_awkward_values(spark):
    df = long(spark, [0.0, -3.0, float("nan"), 5.0])
    assert column(df.select(transforms.safe_log(F.col("value")), "date"), "date")[:2] == [None, None]
    assert column(df.select(transforms.clean(F.col("value")), "date"), "date")[2] is None
    same = long(spark, [2.0, 2.0])
    assert column(same.select(transforms.zscore(F.col("value")), "date"), "date") == [None, None]


def rolled(values, days, lag, reduce):
    """By a plain loop: what becomes known after the decision day before and up to each one."""
    out, days = {}, sorted(days)
    for k, day in enumerate(days):
        back = 3 if day.weekday() == 0 else 2 if day.weekday() == 6 else 1
        since = days[k - 1] if k else day - dt.timedelta(back)
        found = [v for d, v in values if v is not None and since < d + dt.timedelta(lag) <= day]
        out[day] = reduce(found) if found else None
    return out


def mean(xs):
    return sum(xs) / len(xs)


@pytest.mark.parametrize("lag", [0, 1, 2])
def test_roll_forward_equals_a_loop(spark, lag):
    """Two series over three weeks with a holiday inside a week, days without a value and a NULL on the last day."""
    draw = random.Random(43 + lag)
    first = D("2022-11-14")
    days = [d for k in range(21) if (d := first + dt.timedelta(k)).weekday() < 5 and k not in (9, 10)]
    rows = [(name, first + dt.timedelta(k - 3), draw.choice([None, draw.gauss(0, 9), draw.gauss(0, 9)])) for name in ("mean", "top") for k in range(24) if draw.random() < 0.8]
    rows += [("mean", days[-1] - dt.timedelta(lag), None)]
    got = timealign.roll_forward(spark.createDataFrame(rows, "series_id string, date date, value double"), spark.createDataFrame([(d,) for d in days], "decision_day date"), lag, extremes=("top",))
    for name, reduce in (("mean", mean), ("top", max)):
        want = rolled([r[1:] for r in rows if r[0] == name], days, lag, reduce)
        have = {r.decision_day: r.value for r in got.collect() if r.series_id == name}
        assert have == {d: None if v is None else pytest.approx(v) for d, v in want.items()}


def test_measure_set_rebuilds_the_composite(spark):
    draw = random.Random(44)
    first, names = D("2021-06-17"), {"LEVEL": "mean", "INNOV": "mean", "JUMP": "max"}
    days = [d for k in range(1, 12) if (d := first + dt.timedelta(k)).weekday() < 5]
    rows = [(s, m, first + dt.timedelta(k), draw.gauss(5, 3)) for s in ("x", "y") for m in names for k in range(10)]
    out = timealign.roll_measures(spark.createDataFrame(rows, "series_id string, measure string, date date, value double"), spark.createDataFrame([(d,) for d in days], "decision_day date"), 1, names)
    got = {(r.series_id, r.measure, r.decision_day): r.value for r in out.collect()}
    for s in ("x", "y"):
        want = {m: rolled([(r[2], r[3]) for r in rows if r[:2] == (s, m)], days, 1, mean if how == "mean" else max) for m, how in names.items()}
        for d in days:
            for m in names:
                assert got.get((s, m, d)) == (None if want[m][d] is None else pytest.approx(want[m][d]))
            if want["LEVEL"][d] is not None and want["JUMP"][d] is not None:
                assert got[s, "LEVEL_PLUS_JUMP", d] == pytest.approx(want["LEVEL"][d] + want["JUMP"][d])
    with pytest.raises(ValueError, match="no reducer"):
        timealign.roll_measures(out, out, 1, {"LEVEL": "mean", "JUMP": None})
    with pytest.raises(ValueError, match="needed"):
        timealign.roll_measures(spark.createDataFrame(rows, "series_id string, measure string, date date, value double"), spark.createDataFrame([(days[0],)], "decision_day date"), 1, {"LEVEL": "mean"})


def test_month_rules(spark):
    df = spark.createDataFrame([("a", D("2020-01-01"), 1.0), ("a", D("2020-01-20"), None), ("a", D("2020-03-05"), 4.0), ("s", D("2020-01-03"), 2.0), ("s", D("2020-03-03"), 5.0)], "series_id string, date date, value double")
    assert column(df.limit(1).select(timealign.next_month(F.col("date"))), 1) == [D("2020-02-01")]
    got = {(r.series_id, r.month.month): r.value for r in timealign.monthly(df, sums=("s",)).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): None, ("a", 3): 4.0, ("s", 1): 2.0, ("s", 2): 0.0, ("s", 3): 5.0}


def test_splice_prefers_the_first(spark):
    draw = random.Random(45)
    first = D("2019-03-01")
    a = {first + dt.timedelta(k): draw.uniform(10, 20) for k in range(6, 14)}
    b = {first + dt.timedelta(k): draw.uniform(70, 90) for k in range(0, 11) if k != 3}
    make = lambda x: spark.createDataFrame(list(x.items()), "date date, value double")
    got = {r.date: r.value for r in timealign.splice(make(a), make(b)).collect() if r.value is not None}

    def returns(x):
        days = sorted(x)
        return {d: math.log(x[d] / x[c]) for c, d in zip(days, days[1:], strict=False)}

    assert got == {d: pytest.approx(v) for d, v in (returns(b) | returns(a)).items()}


def test_merge_keeps_old_metadata(spark):
    old = spark.createDataFrame([("a", 1, 1.0, "old"), ("b", 1, 2.0, "old")], "series_id string, k int, value double, source string")
    new = spark.createDataFrame([("b", 1, 9.0, "new"), ("c", 1, 3.0, "new")], "series_id string, k int, value double, source string")
    got = {r.series_id: (r.value, r.source) for r in store.merged(old, new, ["series_id", "k"], update=("value",)).collect()}
    assert got == {"a": (1.0, "old"), "b": (9.0, "old"), "c": (3.0, "new")}


def test_store_guards(spark, tmp_path):
    df = spark.createDataFrame([(D("2024-01-01"), 1.0)], "date date, x double")
    with pytest.raises(ValueError, match="missing columns"):
        store.scan(df, ["x", "y"])
    with pytest.raises(ValueError, match="codes"):
        store.scan_prefixed(df, "n_", ["n_AA"])
    with pytest.raises(ValueError, match="unknown"):
        store.dispatch({"a": lambda: df, "b": None}, "b")
    twice = spark.createDataFrame([("a", D("2024-01-01"), 1.0)] * 2, "series_id string, date date, value double")
    with pytest.raises(ValueError, match="duplicate"):
        store.wide(twice, ["a"])
    store.save_version(df, str(tmp_path), "v1")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store.save_version(df, str(tmp_path), "v1")
    assert store.empty(spark, "ext_series").count() == 0
    shuffled = twice.union(long(spark, [1.0, 2.0])).orderBy("value")
    assert store.fingerprint(shuffled).collect() == store.fingerprint(shuffled.orderBy(F.desc("date"))).collect()


def test_last_known(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    facts = spark.createDataFrame([("a", t("2024-01-02 12:00"), D("2024-01-01"), 1.0), ("a", t("2024-01-03 12:00"), D("2024-01-02"), 2.0)], "series_id string, available_at timestamp, date date, value double")
    times = spark.createDataFrame([("a", t("2024-01-02 11:59")), ("a", t("2024-01-02 12:00")), ("a", t("2024-01-09 00:00"))], "series_id string, decision_time timestamp")
    assert column(timealign.last_known(facts, times).select("value", "decision_time"), "decision_time") == [None, 1.0, 2.0]


@pytest.mark.parametrize("measure", ["jump", "innovation", "surprise"])
def test_the_future_moves_nothing(spark, measure):
    import random

    draw = random.Random(3)
    values = [draw.gauss(0, 1) for _ in range(160)]

    def run(xs):
        df = long(spark, xs, "2023-01-01")
        if measure == "jump":
            out = W.jump(df, window=60, least=20)
        elif measure == "innovation":
            out = W.innovation(df, 2, least=30)
        else:
            out = W.surprise(df.withColumns({"acts": F.col("value"), "threats": F.col("value") * F.col("value")}), k=2, least=40)
        return [r[measure] for r in out.orderBy("date").collect()]

    before, after = run(values), run(values[:120] + [v + 50 for v in values[120:]])
    past = lambda xs: [-1e9 if x is None else x for x in xs[:120]]
    assert past(before) == pytest.approx(past(after))
    assert before[120:] != after[120:]


def test_expanding_autoregression_equals_refits(spark):
    import random

    import numpy as np

    draw = random.Random(8)
    x = [0.0, 0.0]
    for _ in range(118):
        x.append(0.5 * x[-1] - 0.2 * x[-2] + draw.gauss(0, 1))
    got = [r.persistent for r in W.persistent(long(spark, x, "2023-01-01"), 2, least=30).orderBy("date").collect()]
    for t in range(len(x)):
        if t < 30:
            assert got[t] is None
            continue
        rows = np.array([[1, x[k - 1], x[k - 2]] for k in range(2, t)])
        coef = np.linalg.lstsq(rows, np.array(x[2:t]), rcond=None)[0]
        assert got[t] == pytest.approx(float(coef @ [1, x[t - 1], x[t - 2]]), abs=1e-9)


def test_episodes_compare_with_the_previous_hit(spark):
    hits = spark.createDataFrame([("a", D(d), 1.0) for d in ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-25", "2024-02-05")], "series_id string, date date, value double")
    assert column(W.episodes(hits, 10).select("episode", "date"), "date") == [1, 1, 1, 1, 2]


def test_shock_transform_chooses_and_refuses(spark):
    df = long(spark, [0.0, 3.0, 8.0])
    assert column(W.shock_transform(df, "log1p").select("value", "date"), "date") == pytest.approx([0, math.log(4), math.log(9)])
    assert sum(column(W.shock_transform(df, "zscore").select("value", "date"), "date")) == pytest.approx(0)
    assert column(W.shock_transform(df).select("value", "date"), "date") == [None, None, None]
    with pytest.raises(ValueError, match="cubed"):
        W.shock_transform(df, "cubed")


def test_percent_rank_equals_a_search(spark):
    draw = random.Random(8)
    rows = [(s, dt.date(1999, 1, 1) + dt.timedelta(days=draw.randint(0, 1100)), None if draw.random() < 0.1 else float(draw.randint(0, 9))) for s in "ab" for _ in range(400)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "series_id string, date date, value double, _n int").repartition(3)
    for days in (365, 40):
        want = []
        for s, d, v in rows:
            seen = [w for t, e, w in rows if t == s and w is not None and dt.timedelta(0) <= d - e <= dt.timedelta(days=days)]
            want.append((s, d, v, None if v is None else round(sum(w <= v for w in seen) / len(seen), 9)))
        got = [(r.series_id, r.date, r.value, r.pct_rank if r.pct_rank is None else round(r.pct_rank, 9)) for r in W.percent_rank_year(df, days).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(ValueError):
        W.percent_rank_year(df, 366)


def test_fingerprint_tells_content_not_order(spark):
    rows = [(k, None if k % 5 == 0 else k / 7, "x" * (k % 3)) for k in range(50)]
    make = lambda r: store.fingerprint(spark.createDataFrame(r, "a long, v double, t string").repartition(3)).first()
    one = make(rows)
    assert one == make(rows[::-1]) and len(one.mark) == 12 and one.n == 50
    assert one.mark != make(rows[:-1]).mark and one.mark != make([*rows[:-1], (49, 7.5, "x")]).mark and one.mark != make(rows + rows[:1]).mark
    assert make([]).mark == "0" * 12


def test_surprises_equal_refits(spark):
    """Each row's forecast is a least-squares fit on the rows before it, refitted by numpy."""
    draw = np.random.default_rng(12)
    n, k = 150, 2
    acts, threats, words = (np.cumsum(draw.standard_normal(n)) for _ in range(3))
    rows = [("s", i, float(acts[i]), float(threats[i]), float(words[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, date int, acts double, threats double, words double")

    def refits(x, first, least):
        out = {}
        for t in range(first, n):
            past = np.arange(first, t)
            if len(past) >= least:
                b = np.linalg.lstsq(np.c_[np.ones(len(past)), x[past]], acts[past], rcond=None)[0]
                out[t] = acts[t] - b[0] - x[t] @ b[1:]
        return out

    lagged = np.full((n, 2 * k), np.nan)
    for j in range(1, k + 1):
        lagged[j:, j - 1], lagged[j:, k + j - 1] = acts[:-j], threats[:-j]
    want = refits(lagged, k, 40)
    got = {r.date: r.surprise for r in W.surprise(df, k=k, least=40).collect() if r.surprise is not None}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-7) for t in want)
    dated = df.withColumn("date", F.date_add(F.lit("2000-01-01").cast("date"), F.col("date")))
    step = {(r.date - dt.date(2000, 1, 1)).days: float(r.state[1]) for r in W.ladder(dated, "words", "threats", "acts").collect()}
    lagged = np.full((n, 2 * k + 1), np.nan)
    for j in range(1, k + 1):
        lagged[j:, j - 1], lagged[j:, k + j - 1] = threats[:-j], words[:-j]
    lagged[1:, -1] = [step[t] for t in range(n - 1)]
    want = refits(lagged, k, 40)
    got = {(r.date - dt.date(2000, 1, 1)).days: r.surprise for r in W.full_surprise(dated, "acts", "threats", "words", k, 40).collect() if r.surprise is not None}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-6) for t in want)
