"""Stateful processors row by row against the batch measures, and the revision sink's batches."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremor.operators import windows
from tremor.plans import signals, streams
from tremor.streaming import stateful
from tremor.streaming.revisions import StoreSink

DAY = 86_400_000_000


class Kept:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Handle:
    """What a processor asks of its handle; state goes through a copy, as through a store."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Kept())

    def registerTimer(self, at):
        self.timers.add(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def replay(job, batches, late):
    """Rows in batches of (at, value); after each batch the watermark moves on and due timers fire."""
    handle, out, mark = Handle(), [], 0
    job.init(handle)
    for rows in batches:
        frame = pd.DataFrame(rows, columns=["at", "value"])
        out += [*job.handleInputRows(("k",), iter([frame]), Watermark(mark))]
        mark = max(mark, max((t for t, _ in rows), default=0) // 1000 - late // 1000)
        for due in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(due)
            out += [*job.handleExpiredTimer(("k",), Watermark(mark), None)]
    return [tuple(r)[1:] for f in out for r in f.itertuples(index=False)]


@pytest.mark.parametrize("order", [1, 2])
def test_online_shocks_equal_the_batch_measures(spark, order):
    draw = random.Random(5)
    values = [draw.gauss(0, 1) + (4 if k % 37 == 0 else 0) for k in range(330)]
    values[100:150] = [1.0] * 50
    rows = [(k * DAY, v) for k, v in enumerate(values)]
    shuffled = [rows[k : k + 60] for k in range(0, 330, 60)]
    for part in shuffled:
        draw.shuffle(part)
    got = replay(stateful.OnlineShocks("series_id", order, 30, 80), [*shuffled, [(400 * DAY, 0.0)]], DAY)
    df = spark.createDataFrame([("k", k, v) for k, v in enumerate(values)], "series_id string, date int, value double")
    want = windows.jump(windows.innovation(df, order, 30), 80).orderBy("date").collect()
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w.date * DAY
        for a, b in zip(g[1:], (w.value, w.persistent, w.innovation, w.z, w.jump), strict=True):
            assert (np.isnan(a) and b is None) or a == pytest.approx(b, abs=1e-8)


def test_arrival_order_and_batches_change_nothing():
    draw = random.Random(7)
    rows = [(k * DAY // 3, draw.gauss(0, 50)) for k in range(200)]
    end = [[(999 * DAY, 0.0)]]
    for make in (lambda: stateful.Triggers("k", 60, 2 * DAY), lambda: stateful.StateDays("k", 10), lambda: stateful.OnlineShocks("k", 1, 20, 40)):
        whole = replay(make(), [rows, *end], DAY)
        pieces = [rows[k : k + 30] for k in range(0, 200, 30)]
        for p in pieces:
            draw.shuffle(p)
        again = replay(make(), pieces + end, 12 * DAY)
        assert sorted(map(str, whole)) == sorted(map(str, again)) and len(whole) > 5


def test_silence_comes_by_a_timer_once():
    job = stateful.Triggers("k", 10, 2 * DAY)
    quiet = replay(job, [[(DAY, 50.0)], [], [(9 * DAY, 1.0)]], 0)
    assert (3 * DAY, "silence", 50.0) in quiet and sum(r[1] == "silence" for r in quiet) == 1
    handle = Handle()
    job = stateful.Triggers("k", 10, 2 * DAY)
    job.init(handle)
    first = list(job.handleInputRows(("k",), iter([pd.DataFrame({"at": [DAY], "value": [50.0]})]), Watermark(DAY // 1000 + 5)))
    assert not first and handle.timers == {3 * DAY // 1000 + 1}
    (alert,) = job.handleExpiredTimer(("k",), Watermark(3 * DAY // 1000 + 1), None)
    assert alert.values.tolist() == [["k", 3 * DAY, "silence", 50.0]]
    assert not list(job.handleExpiredTimer(("k",), Watermark(4 * DAY // 1000), None))


def test_a_row_at_the_watermark_waits_and_is_not_lost():
    got = replay(stateful.StateDays("k", 0), [[(0, 1.0), (DAY, 1.0)], [(2 * DAY, 1.0)], [(5 * DAY, 1.0)]], DAY)
    assert [r[0] for r in got] == [0, DAY, 2 * DAY]


def stamp(day):
    return datetime(2020, 1, 1) + timedelta(days=day)


@pytest.fixture
def sink(tmp_path):
    return StoreSink(f"file://{tmp_path}/s", ["series_id", "date"])


def batch(spark, rows):
    df = spark.createDataFrame([(s, stamp(d), v, src, stamp(a)) for s, d, v, src, a in rows], "series_id string, day timestamp, value double, source string, available_at timestamp")
    return df.select("series_id", F.to_date("day").alias("date"), "value", "source", "available_at")


def test_revisions_keep_their_time_and_batches_can_be_repeated(spark, sink):
    one = batch(spark, [("a", 0, 1.0, "first", 1), ("a", 1, 2.0, "first", 2), ("a", 1, 2.5, "fix", 5), ("a", 40, 3.0, "first", 41)])
    two = batch(spark, [("a", 0, 9.0, "fix", 44), ("b", 2, 4.0, "first", 3), ("a", 41, 5.0, "first", 42)])
    sink(one, 0)
    sink(two, 1)
    look = lambda: sorted((r.series_id, r.date.timetuple().tm_yday - 1, r.value, r.source, (r.available_at - stamp(0)).days) for r in sink.read(spark).collect())
    want = [("a", 0, 9.0, "first", 1), ("a", 1, 2.5, "first", 2), ("a", 40, 3.0, "first", 41), ("a", 41, 5.0, "first", 42), ("b", 2, 4.0, "first", 3)]
    assert look() == want
    routes = lambda: sorted((r.batch, r.series_id, r.value, r.route) for r in sink.routes(spark).collect())
    seen = routes()
    assert seen == [(0, "a", 1.0, "new"), (0, "a", 2.5, "revision"), (0, "a", 3.0, "new"), (1, "a", 5.0, "new"), (1, "a", 9.0, "revision"), (1, "b", 4.0, "late")]
    sink(two, 1)  # a batch that is run again
    assert look() == want and routes() == seen
    sink(two.limit(0), 2)
    assert look() == want and sink.read(spark, 0).count() == 3 and sink.read(spark, -1).count() == 0


def test_an_empty_sink_reads_as_nothing(spark, sink):
    assert sink.read(spark) is None and sink.routes(spark) is None


@pytest.fixture
def events(spark, tmp_path):
    """An events table of several files, written in the given order: (event_id, hour, user_id, event_type, value)."""

    def write(rows):
        made = [(e, datetime(2020, 1, 1) + timedelta(hours=h), u, k, v) for e, h, u, k, v in rows]
        df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
        df.repartition(3, "event_id").write.parquet(f"file://{tmp_path}/events.parquet")
        return f"file://{tmp_path}"

    return write


def test_sessions_that_are_open_at_the_end_come_out_too(spark, events):
    at = events([(1, 0, 1, "click", 1.0), (2, 11, 1, "click", 1.0), (3, 60, 1, "click", 1.0), (4, 59, 2, "view", 1.0), (5, 60, None, "view", 1.0)])
    got = {(r.user_id, (r.start - stamp(0)) // timedelta(hours=1), (r["last"] - r.start) // timedelta(hours=1), r.n) for r in signals.st04_sessions(spark, at).collect()}
    assert got == {(1, 0, 11, 2), (1, 60, 0, 1), (2, 59, 0, 1), (None, 60, 0, 1)}


def test_the_earliest_of_equal_content_is_kept_whatever_comes_first(spark, events):
    rows = [(k, 300 - k, 1, "click", 5.0) for k in range(60)] + [(100, 300, 1, "view", 5.0), (101, 2, None, "view", None), (102, 200, None, "view", None)]
    got = {r.event_id for r in signals.st02_content_dedup(spark, events(rows)).collect()}
    assert got == {59, 100, 101}


def test_triggers_equal_their_sql_where_rows_repeat_and_users_overlap(spark, events):
    """Copies at the same times, those of a user among them: equal rows are in no order that could change an alert."""
    draw = random.Random(3)
    base = [(4 * k + draw.randrange(3), draw.randrange(6), round(draw.expovariate(1 / 80), 2)) for k in range(200)] + [(103, 50, 150.0), (403, 50, 1.0)]
    at = events([(n * 1000 + k, t, u + n // 3, "click", v) for n in range(9) for k, (t, u, v) in enumerate(base)])
    job, text = streams.QUERIES["st05_triggers"]
    con = duckdb.connect()
    con.sql(f"create view events as select * from read_parquet('{at.removeprefix('file://')}/events.parquet/*.parquet')")
    want = con.sql(f"select actor, epoch_us(ts), rule, value from ({text})").fetchall()
    got = job(spark, at).select("actor", F.unix_micros(F.col("ts").cast("timestamp")), "rule", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r.rule for r in got} == {"jump", "p90", "state", "silence"}
