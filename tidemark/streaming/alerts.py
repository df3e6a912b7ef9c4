"""Alert intervals on a stream: a rule fires when its condition held for its duration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INTERVALS = "key string, started_at timestamp, last_seen timestamp, worst_value double, status string"
HELD, LATE = "held", "late"
MICROS = 1_000_000
# Of a sample's time, value and condition.
KINDS = (np.int64, np.float64, bool)


class HeldCondition(StatefulProcessor):
    """Runs of bad samples per key, in event time.

    Samples wait until the newest one is ``delay`` seconds past them and are then judged in order:
    a bad one opens or continues a run, a good one ends it. An ended run that lasted at least
    ``hold`` seconds is emitted. Samples older than what was judged already change no run; each is
    emitted as it is with the status late, so that they can be counted.
    """

    def __init__(self, hold: int, delay: int):
        self.hold, self.delay = hold * MICROS, delay * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._waiting = handle.getMapState("waiting", "at long", "value double, bad boolean", None)
        self._run = handle.getValueState("run", "started long, last long, worst double, judged long", None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, last, worst, judged = self._run.get() if self._run.exists() else (None, None, None, None)
        kept = [(k[0], *v) for k, v in self._waiting.iterator()]
        # State is a call per sample, so only those that wait for a later batch are written to it.
        parts = [[np.array(x, kind) for x, kind in zip(list(zip(*kept)) or [[]] * 3, KINDS)]]
        parts += [[frame[c].to_numpy(kind) for c, kind in zip(("at", "value", "bad"), KINDS)] for frame in rows]
        at, value, bad = (np.concatenate(x) for x in zip(*parts))
        delivered = np.arange(len(at)) >= len(kept)
        newest = int(at.max()) if judged is None else max(judged, int(at.max(initial=judged)))
        late = at <= judged if judged is not None else np.zeros(len(at), bool)
        out = [_intervals(key[0], at[late], at[late], value[late], LATE)]
        order = np.flatnonzero(~late)
        order = order[np.argsort(at[order], kind="stable")]
        # Of a time's samples the last delivered counts.
        order = order[np.diff(at[order], append=np.iinfo(np.int64).max) != 0]
        ripe = at[order] <= newest - self.delay
        for t in at[: len(kept)][at[: len(kept)] <= newest - self.delay].tolist():
            self._waiting.removeKey((t,))
        for i in order[~ripe & delivered[order]].tolist():
            self._waiting.updateValue((int(at[i]),), (float(value[i]), bool(bad[i])))
        order = order[ripe]
        if len(order):
            judged = int(at[order[-1]])
            runs, (started, last, worst) = _runs(at[order], value[order], bad[order], (started, last, worst))
            long = runs[1] - runs[0] >= self.hold
            out.append(_intervals(key[0], *(x[long] for x in runs), HELD))
        self._run.update((started, last, worst, judged))
        out = [x for x in out if len(x)]
        if out:
            yield pd.concat(out, ignore_index=True)

    def close(self) -> None:
        pass


def _runs(at: np.ndarray, value: np.ndarray, bad: np.ndarray, open_run: tuple) -> tuple[list[np.ndarray], tuple]:
    """Starts, ends and worst values of the runs that a good sample ends, and the run that stays open.

    Samples are sorted by time and later than ``open_run`` (start, end, worst), the run that was open before, if any.
    """
    started, last, worst = open_run
    if started is not None:
        at, value, bad = (np.concatenate(([x], y)) for x, y in ((last, at), (worst, value), (True, bad)))
    edges = np.diff(bad.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(first):
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], (None, None, None)
    starts, ends = at[first], at[end - 1]
    if started is not None:
        starts[0] = started
    # No number is worse than one that is not a number and begins a run; within a run such are passed over.
    most = np.fmax.reduceat(np.append(value, np.nan), np.stack((first, end), 1).ravel())[::2]
    most = np.where(np.isnan(value[first]), np.nan, most)
    ended = end < len(at)
    left = (None, None, None) if ended[-1] else (int(starts[-1]), int(ends[-1]), float(most[-1]))
    return [starts[ended], ends[ended], most[ended]], left


def _intervals(key: str, started: np.ndarray, last: np.ndarray, worst: np.ndarray, status: str) -> pd.DataFrame:
    times = [pd.to_datetime(x, unit="us") for x in (started, last)]
    return pd.DataFrame({"key": key, "started_at": times[0], "last_seen": times[1], "worst_value": worst, "status": status})


def held_intervals(samples: DataFrame, key: str, bad: Column, hold_seconds: int, delay_seconds: int, time: str = "ts", value: str = "value") -> DataFrame:
    """key, started_at, last_seen, worst_value of every ended run of bad samples that held long enough (status held).

    A sample that comes after later ones were judged is a row of its own with the status late. The held rows equal the batch ``alert_intervals`` over samples that a later good one has followed. Samples
    of a key at one time count once, the last delivered. Needs the RocksDB state store.
    """
    judged = samples.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(
        F.col(key).alias("key"), F.unix_micros(time).alias("at"), F.col(value).cast("double").alias("value"), F.coalesce(bad, F.lit(False)).alias("bad")
    )
    return judged.groupBy("key").transformWithStateInPandas(
        HeldCondition(hold_seconds, delay_seconds), outputStructType=INTERVALS, outputMode="Append", timeMode="None"
    )
