"""Streams with state of their own: online shocks, trigger rules and days in state, each row in event-time order.

Rows wait in their key's state until the watermark has passed them and are then taken in order of time, so that the result
doesn't depend on the order of arrival within the watermark's delay. What a key keeps is bounded: sums of products, the last
few values, a ring of the last `window` ones, and the rows that still wait.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from tremor.sources.shared import new_place

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = 1000  # microseconds


class Ordered(StatefulProcessor):
    """Takes (key, at: microseconds, value) rows of a key in order of time once the watermark has passed them.

    A subclass has `columns` of its output behind the key, the state `begin`s with (a list of doubles), `step` which takes one
    row and may put out rows (each with its time in front), and `quiet` which is asked whenever the watermark moves on.
    """

    columns: Sequence[str] = ()

    def __init__(self, key: str) -> None:
        self.key = key

    def begin(self) -> list[float]:
        return []

    def step(self, state: list[float], at: int, value: float) -> Iterator[tuple]:
        raise NotImplementedError

    def quiet(self, state: list[float], watermark: int) -> Iterator[tuple]:
        yield from ()

    def wake(self, state: list[float]) -> int | None:
        """When `quiet` has something to say if no row comes (microseconds)."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at array<long>, value array<double>, state array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, value, state = self._load()
        for part in rows:
            at += part["at"].astype("int64").tolist()
            value += part["value"].astype("float64").tolist()
        yield from self._go_on(key, at, value, state, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go_on(key, *self._load(), timerValues)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[list[int], list[float], list[float]]:
        if not self.kept.exists():
            return [], [], self.begin()
        at, value, state = self.kept.get()
        return list(at), list(value), list(state)

    def _go_on(self, key, at, value, state, timers) -> Iterator[pd.DataFrame]:
        mark = timers.getCurrentWatermarkInMs() * MS
        out, wait = [], []
        for t, v in sorted(zip(at, value, strict=True)):
            if t < mark:
                out += self.step(state, t, v)
            else:
                wait.append((t, v))
        out += self.quiet(state, mark)
        self.kept.update(([t for t, _ in wait], [v for _, v in wait], [float(x) for x in state]))
        wakes = [t for t in (wait[0][0] if wait else None, self.wake(state)) if t is not None]
        for t in wakes:  # always beyond the watermark: a timer that is set again for the time at which it fires is lost
            self.handle.registerTimer(t // MS + 1)
        if out:
            frame = pd.DataFrame(out, columns=["at", *self.columns])
            frame.insert(0, self.key, pd.Series([key[0]] * len(out), dtype=object))
            yield frame.astype({c: object for c in frame.columns if frame[c].dtype.kind not in "iufb"})


class OnlineShocks(Ordered):
    """persistent, innovation, z and jump of each value, as the batch measures `windows.innovation` and `windows.jump` have them:
    an expanding AR(order) by running sums of products, and rolling moments and quantiles over the last `window` values.

    State: rows seen, complete rows, the shift, sums of products, right-hand sides, then the last values and their z.
    """

    columns = ("value", "persistent", "innovation", "z", "jump")

    def __init__(self, key: str, order: int = 1, least: int = 60, window: int = 250, q: float = 0.95) -> None:
        super().__init__(key)
        self.order, self.warm, self.window, self.q, self.few = order, max(least, order + 2), window, q, max(20, window // 4)

    def begin(self) -> list[float]:
        k = self.order + 1
        return [0.0, 0.0, *[0.0] * k, *[0.0] * (k * k + k)]

    def step(self, state, at, value):
        p, k = self.order, self.order + 1
        head = 2 + k + k * k + k
        ring = state[head:]
        values, zs = ring[: len(ring) // 2], ring[len(ring) // 2 :]
        zero, gram, rhs = state[2 : 2 + k], np.reshape(state[2 + k : 2 + k + k * k], (k, k)), np.array(state[2 + k + k * k : head])
        persistent = np.nan
        if len(values) >= p:
            lagged = values[len(values) - p :][::-1]
            if not state[1]:
                zero = [value, *lagged]
            x, y = np.array([1.0, *(a - b for a, b in zip(lagged, zero[1:], strict=True))]), value - zero[0]
            if state[1] >= self.warm - p:
                scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                coef = np.linalg.pinv(gram / scale[:, None] / scale, rcond=1e-13, hermitian=True) @ (rhs / scale) / scale
                persistent = float(coef @ x) + zero[0]
            gram, rhs = gram + np.outer(x, x), rhs + x * y
            state[1] += 1
        z, over = np.nan, np.nan
        past = np.array(values[-self.window :])
        if len(past) >= self.few and (spread := past.std(ddof=1)) > 0:
            z = float((value - past.mean()) / spread)
            known = self.sorted_past(zs)
            if len(known) >= self.few:
                over = z - at_quantile(known, self.q)
        keep = max(self.window, p)
        self.remember(zs, z, keep)
        values = [*values, value][-keep:]
        state[:] = [state[0] + 1, state[1], *zero, *gram.ravel(), *rhs, *values, *[*zs, z][-keep:]]
        yield at, value, persistent, value - persistent, z, max(over, 0.0) if over == over else np.nan

    # The order statistics of one key's last z: rebuilt when a key is loaded, then kept sorted from row to row.
    _sorted: list[float] | None = None
    _for: list[float] | None = None

    def sorted_past(self, zs: list[float]) -> list[float]:
        if self._for != zs:
            self._sorted = sorted(z for z in zs[-self.window :] if z == z)
        return self._sorted

    def remember(self, zs: list[float], z: float, keep: int) -> None:
        """Keeps the sorted values in step with the ring."""
        known = self.sorted_past(zs)
        if len(zs) >= self.window and (gone := zs[-self.window]) == gone:
            del known[bisect_left(known, gone)]
        if z == z:
            insort(known, z)
        self._for = [*zs, z][-keep:]


def at_quantile(known: Sequence[float], q: float) -> float:
    """The linearly interpolated quantile of sorted values."""
    place = q * (len(known) - 1)
    low = int(place)
    high = min(low + 1, len(known) - 1)
    return known[low] + (known[high] - known[low]) * (place - low)


class Triggers(Ordered):
    """Alerts of a key: `jump` and `p90` for values above the past 97.5 and 90 percent quantiles of the last `window` values
    (from `least` on), `state` when it turns high (above `limit`) or calm, `silence` when a high key says nothing for `hush`
    microseconds; that one comes by a timer, at the time it expires.

    State: the last row's time and value, whether silence was told, then the last values.
    """

    columns = ("rule", "value")

    def __init__(self, key: str, limit: float, hush: int, window: int = 50, least: int = 10) -> None:
        super().__init__(key)
        self.limit, self.hush, self.window, self.least = limit, hush, window, least

    def begin(self) -> list[float]:
        return [np.nan, np.nan, 0.0]

    def _silent(self, state, until):
        last, value, told = state[:3]
        if last == last and value > self.limit and not told and last + self.hush < until:
            state[2] = 1.0
            yield int(last) + self.hush, "silence", value

    def step(self, state, at, value):
        yield from self._silent(state, at)
        past = sorted(state[3:])
        if len(past) >= self.least:
            for rule, q in (("jump", 0.975), ("p90", 0.9)):
                if value > at_quantile(past, q):
                    yield at, rule, value
        if state[1] == state[1] and (state[1] > self.limit) != (value > self.limit):
            yield at, "state", value
        state[:] = [float(at), value, 0.0, *[*state[3:], value][-self.window :]]

    def quiet(self, state, watermark):
        yield from self._silent(state, watermark)

    def wake(self, state):
        last, value, told = state[:3]
        return int(last) + self.hush if last == last and value > self.limit and not told else None


class StateDays(Ordered):
    """state and days_in_state of each row: the days since the first row of the current run of equal states, this day included.
    A value above `limit` is high, else calm. State: whether the last row was high, and the first day of its run."""

    columns = ("state", "days_in_state")

    def __init__(self, key: str, limit: float) -> None:
        super().__init__(key)
        self.limit = limit

    def begin(self) -> list[float]:
        return [np.nan, np.nan]

    def step(self, state, at, value):
        high, day = float(value > self.limit), at // 86_400_000_000
        if state[0] != high:
            state[:] = [high, float(day)]
        yield at, "high" if high else "calm", int(day - state[1]) + 1


def stateful(rows: DataFrame, key: str, time: str, value: str, job: Ordered, kinds: str, late: str) -> DataFrame:
    """The stream `rows` (key: string, a time, a number) through `job`: key, at (the time) and the job's columns, whose types
    `kinds` gives. Rows without a key, a time or a number are left out; rows later than `late` are dropped."""
    ready = rows.select(F.col(key).cast("string").alias(job.key), F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value")).dropna()
    ready = ready.withColumn("at", F.unix_micros("time")).withWatermark("time", late)
    out = ready.groupBy(job.key).transformWithStateInPandas(statefulProcessor=job, outputStructType=f"{job.key} string, at long, {kinds}", outputMode="append", timeMode="eventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


@contextmanager
def bounded_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB rather than on the heap, in at most two partitions a core: a state
    store for each shuffle partition lives through all batches."""
    most = min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    before = {name: spark.conf.get(name, None) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(PARTITIONS, most)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def arriving(spark: SparkSession, rows: DataFrame, time: str, name: str, job: Callable[[DataFrame], DataFrame], arrivals: int = 3, sink: Callable[[str], Callable[[DataFrame, int], None]] | None = None) -> tuple[DataFrame | None, str]:
    """What an append-mode stream over `rows` has put out after they arrived in `arrivals` parts by time, and its folder.

    The query is started anew for each part and goes on from its checkpoint, as after a failure. `job` makes the output of the
    stream; with a `sink`, what sink(folder) returns takes each batch with its number, and there is no table of the output.
    """
    at = new_place(spark, name)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    ends = rows.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))  # one row
    part = F.least(F.floor((t - F.col("_lo")) * arrivals / (F.col("_hi") - F.col("_lo") + 1)), F.lit(arrivals - 1)).cast("int")
    rows.crossJoin(F.broadcast(ends)).withColumn("_part", part).drop("_lo", "_hi").write.partitionBy("_part").parquet(f"{at}/rows")
    waiting = spark.read.schema(StructType([*rows.schema, StructField("_part", IntegerType())])).parquet(f"{at}/rows")
    with bounded_state(spark):
        for k in range(arrivals):
            waiting.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(f"{at}/landed")
            out = job(spark.readStream.schema(rows.schema).parquet(f"{at}/landed"))
            q = out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
            q = q.foreachBatch(sink(at)) if sink else q.format("parquet").option("path", f"{at}/out")
            q.start().awaitTermination()
    return None if sink else spark.read.schema(out.schema).parquet(f"{at}/out"), at
