"""CUSUM charts over a stream: the batch charts' recursion as keyed state.

State per run and variable holds both sums, the position, the first alarm and the peak. Rows at or
before the last position of their series are late: they cannot enter the recursion and are counted. Over
event time (``stream_event_cusum``) rows wait for the watermark, late ones are put out, and idle series end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..config import Thresholds

OUTPUT = "run_id string, variable string, seq long, c_pos double, c_neg double, onset long, direction string, peak double, n_late long"
STATE = "c_pos double, c_neg double, seq long, onset long, direction string, peak double, n_late long"


def step(state: tuple, rows: pd.DataFrame, k: float, h: float) -> tuple:
    """The state after the rows, in their order of position: running sums minus their running extremes,
    as in the batch charts, started from the state's own."""
    up, down, last, onset, side, peak, late = state
    rows = rows.sort_values("seq", kind="stable")
    seq = rows["seq"].to_numpy()
    fresh = (seq > last) & np.append(True, seq[1:] != seq[:-1]) if len(seq) else np.empty(0, bool)
    late += int(len(seq) - fresh.sum())
    if not fresh.any():
        return up, down, last, onset, side, peak, late
    seq, z = seq[fresh], rows["z"].to_numpy(float)[fresh]
    z = np.where(np.isnan(z), 0.0, z)
    ups, downs = up + np.cumsum(z - k), down + np.cumsum(z + k)
    ups, downs = ups - np.minimum(0.0, np.minimum.accumulate(ups)), downs - np.maximum(0.0, np.maximum.accumulate(downs))
    alarm = np.flatnonzero((ups > h) | (downs < -h))
    if onset < 0 and len(alarm):
        onset, side = int(seq[alarm[0]]), "decrease" if downs[alarm[0]] < -h else "increase"
    return float(ups[-1]), float(downs[-1]), int(seq[-1]), onset, side, float(max(peak, ups.max(), -downs.min())), late


def stream_cusum(obs: DataFrame, base: DataFrame, h: float, t: Thresholds = Thresholds()) -> DataFrame:
    """From streaming observations and a static baseline: a row per series and batch with its state."""
    k = t.shift / 2
    z = (F.col("value") - F.col("pooled_mean")) / F.nullif("pooled_std", F.lit(0.0))
    rows = obs.join(base.select("variable", "pooled_mean", "pooled_std"), "variable").select("run_id", "variable", "seq", z.alias("z"))

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0.0, 0.0, -1, -1, "", 0.0, 0)
        now = step(now, pd.concat(list(batches)), k, h)
        state.update(now)
        up, down, last, onset, side, peak, late = now
        yield pd.DataFrame({"run_id": [key[0]], "variable": [key[1]], "seq": [last], "c_pos": [up], "c_neg": [down], "onset": pd.array([None if onset < 0 else onset], "Int64"), "direction": [side or None], "peak": [peak], "n_late": [late]})

    return rows.groupBy("run_id", "variable").applyInPandasWithState(update, OUTPUT, STATE, "update", "NoTimeout")


#: What a series keeps between batches, and the rows that the watermark has not passed.
CHART = "c_pos double, c_neg double, last long, onset long, direction string, peak double, n long, n_late long"
WAITING = "at long, z double"
EVENTS = "kind string, run_id string, variable string, at timestamp, z double, c_pos double, c_neg double, onset timestamp, direction string, peak double, n long, n_late long"
EMPTY = (0.0, 0.0, -1, -1, "", 0.0, 0, 0)


def advance(state: tuple, at: np.ndarray, z: np.ndarray, k: float, h: float) -> tuple:
    """The state after rows in the order of their times; rows of one time follow one another."""
    up, down, _, onset, side, peak, n, late = state
    z = np.where(np.isnan(z), 0.0, z)
    ups, downs = up + np.cumsum(z - k), down + np.cumsum(z + k)
    ups, downs = ups - np.minimum(0.0, np.minimum.accumulate(ups)), downs - np.maximum(0.0, np.maximum.accumulate(downs))
    alarm = np.flatnonzero((ups > h) | (downs < -h))
    if onset < 0 and len(alarm):
        onset, side = int(at[alarm[0]]), "decrease" if downs[alarm[0]] < -h else "increase"
    return float(ups[-1]), float(downs[-1]), int(at[-1]), onset, side, float(max(peak, ups.max(), -downs.min())), n + len(at), late


class EventCharts(StatefulProcessor):
    """A series' chart over event time. Rows wait until the watermark has passed them and then enter in the
    order of their times; rows behind it are late: they are put out and counted, and never enter. A series
    without a row for ``idle`` after its last one is closed, and its state goes."""

    def __init__(self, k: float, h: float, idle: int):
        self.k, self.h, self.idle = k, h, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.chart = handle.getValueState("chart", CHART)
        self.waiting = handle.getListState("waiting", WAITING)

    def now(self) -> tuple:
        return tuple(self.chart.get()) if self.chart.exists() else EMPTY

    def wake(self, at: int) -> None:
        """The one timer of the series: just after a time in microseconds."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + 1)

    def rows(self, kind: str, key, at, state: tuple, z=None) -> pd.DataFrame:
        up, down, _, onset, side, peak, n, late = state
        at = pd.to_datetime(np.atleast_1d(at), unit="us")
        same = {"c_pos": up, "c_neg": down, "onset": pd.to_datetime(onset, unit="us") if onset >= 0 else pd.NaT, "direction": side or None, "peak": peak, "n": n, "n_late": late}
        out = pd.DataFrame({"kind": kind, "run_id": key[0], "variable": key[1], "at": at, "z": np.nan if z is None else z})
        for name, value in same.items():
            out[name] = value
        out["onset"] = out["onset"].astype("datetime64[us]")
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        pdf = pd.concat(list(rows))
        at, z = pdf["at"].to_numpy(np.int64), pdf["z"].to_numpy(float)
        late = at <= passed if passed > 0 else np.zeros(len(at), bool)
        state = self.now()
        state = (*state[:7], state[7] + int(late.sum()))
        self.chart.update(state)
        if (~late).any():
            self.waiting.appendList([(int(a), None if np.isnan(v) else float(v)) for a, v in zip(at[~late], z[~late], strict=True)])
        first = min((r[0] for r in self.waiting.get()), default=None)
        self.wake(first if first is not None else max(state[2], passed) + self.idle)
        if late.any():
            yield self.rows("late", key, at[late], state, z[late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(((r[0], r[1]) for r in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
        due, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        state = self.now()
        if not held:
            self.chart.clear()
            yield self.rows("closed", key, max(state[2], 0), state)
            return
        if due:
            state = advance(state, np.array([r[0] for r in due]), np.array([r[1] for r in due], float), self.k, self.h)
            self.chart.update(state)
            self.waiting.clear()
            if rest:
                self.waiting.appendList(rest)
        self.wake(rest[0][0] if rest else state[2] + self.idle)
        if due:
            yield self.rows("chart", key, state[2], state)

    def close(self) -> None:
        pass


def stream_event_cusum(obs: DataFrame, base: DataFrame, h: float, time_col: str = "at", delay: str = "10 minutes", idle_minutes: int = 60, t: Thresholds = Thresholds()) -> DataFrame:
    """From streaming observations with a time (``run_id, variable, value`` and ``time_col``): rows of ``kind``
    ``chart`` (a series' state after what the watermark has passed), ``late`` (rows that came more than ``delay``
    behind, one by one) and ``closed`` (a series without a row for ``idle_minutes``). Needs RocksDB as the
    session's state store, which is set here where the session names none."""
    spark = obs.sparkSession
    store = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(store, ""):
        spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    z = (F.col("value") - F.col("pooled_mean")) / F.nullif("pooled_std", F.lit(0.0))
    marked = obs.withWatermark(time_col, delay)
    # as a number, so that rows behind the watermark reach the processor instead of being dropped before it
    rows = marked.join(base.select("variable", "pooled_mean", "pooled_std"), "variable").select("run_id", "variable", F.unix_micros(time_col).alias("at"), z.alias("z"))
    return rows.groupBy("run_id", "variable").transformWithStateInPandas(EventCharts(t.shift / 2, h, idle_minutes * 60_000_000), EVENTS, "Update", "EventTime")
