"""Feature rows for the live tail, from the hours kept in state per zone."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAGS = (1, 3, 6, 24, 168)
WINDOWS = (4, 12, 24)
HOUR = 3600
LATENESS_HOURS = 48
# A late hour re-emits the hours after it, and those need the longest lag before them.
HISTORY_HOURS = LATENESS_HOURS + max(LAGS) + 1
ROW, LATE, AHEAD = "row", "late", "ahead"

OUTPUT = T.StructType(
    [
        T.StructField("zone", T.StringType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("value", T.DoubleType()),
        *[T.StructField(f"lag_{n}h", T.DoubleType()) for n in LAGS],
        *[T.StructField(f"rolling_mean_{n}h", T.DoubleType()) for n in WINDOWS],
        T.StructField("rolling_std_24h", T.DoubleType()),
        T.StructField("carbon_change_1h", T.DoubleType()),
    ]
)


def feature_rows(known: dict[int, float], wanted: list[int]) -> pd.DataFrame:
    """Features of the ``wanted`` hours, a subset of ``known`` (hour number to value)."""
    series = pd.Series(known, dtype="float64").sort_index()
    series = series.reindex(range(series.index[0], series.index[-1] + 1))
    columns = {"value": series}
    for n in LAGS:
        columns[f"lag_{n}h"] = series.shift(n)
    for n in WINDOWS:
        columns[f"rolling_mean_{n}h"] = series.rolling(n, min_periods=1).mean()
    columns["rolling_std_24h"] = series.rolling(24, min_periods=1).std()
    columns["carbon_change_1h"] = series - series.shift(1)
    table = pd.DataFrame(columns).loc[wanted]
    return table[table["value"].notna()]


class FeatureState(StatefulProcessor):
    """Keeps the last hours of a zone and emits a row per arriving hour.

    An hour no more than LATENESS_HOURS behind the newest one of earlier batches replaces its
    value and re-emits the later hours it feeds, whose full history is still kept; the row of the
    newest batch is the right one (see :func:`newest_rows`). Older hours, and hours more than one
    ahead of the clock, are not taken in; each is emitted with its status, so that they can be counted and
    backfilled.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._hours = handle.getMapState("hours", "hour long", "value double", None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        hours = (initialState["datetime"].astype("datetime64[s]").astype("int64") // HOUR).tolist()
        for hour, value in zip(hours, initialState["value"].tolist()):
            self._hours.updateValue((hour,), (value,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows), ignore_index=True)
        hours = (arrived["datetime"].astype("datetime64[s]").astype("int64") // HOUR).tolist()
        known = {k[0]: v[0] for k, v in self._hours.iterator()}
        oldest = max(known) - LATENESS_HOURS if known else None
        clock = int(time.time()) // HOUR + 1
        taken, left = set(), []
        for hour, value in zip(hours, arrived["value"].tolist()):
            if hour > clock or (oldest is not None and hour < oldest):
                left.append((hour, AHEAD if hour > clock else LATE, value))
                continue
            known[hour] = value
            taken.add(hour)
            self._hours.updateValue((hour,), (value,))
        if left:
            table = pd.DataFrame(left, columns=["hour", "status", "value"])
            yield self._shown(key[0], table)
        if not taken:
            return
        newest = max(known)
        wanted = sorted(h for h in known if h >= min(taken))
        table = feature_rows(known, wanted).reset_index(names="hour").assign(status=ROW)
        for hour in [h for h in known if h <= newest - HISTORY_HOURS]:
            self._hours.removeKey((hour,))
        if not table.empty:
            yield self._shown(key[0], table)

    @staticmethod
    def _shown(zone: str, table: pd.DataFrame) -> pd.DataFrame:
        table = table.assign(zone=zone, datetime=pd.to_datetime(table["hour"] * HOUR, unit="s"))
        return table.reindex(columns=[f.name for f in OUTPUT.fields])

    def close(self) -> None:
        pass


def kept_hours(table: DataFrame) -> DataFrame:
    """The rows of a batch (zone, datetime, value) table that a zone's state would still hold: at most HISTORY_HOURS hours each.

    Null zones, times and values are left out.
    """
    known = table.select("zone", "datetime", F.col("value").cast("double").alias("value")).dropna()
    newest = known.groupBy("zone").agg(F.max("datetime").alias("_newest"))
    behind = F.unix_seconds("_newest") - F.unix_seconds("datetime")
    return known.join(newest, "zone").filter(behind < HISTORY_HOURS * HOUR).drop("_newest")


def live_features(hourly: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Feature rows of an hourly (zone, datetime, value) stream.

    Needs the RocksDB state store. Feed it hourly aggregates, not raw readings: a zone
    then brings one row per hour. With ``table``, the hours before the stream begins, a new stream starts from its last hours
    as if it had read them, without emitting them: history goes through the batch operators, in chunks, and only
    the tail through state. A restarted stream goes on from its checkpoint and reads no table.
    """
    initial = kept_hours(table).groupBy("zone") if table is not None else None
    return hourly.groupBy("zone").transformWithStateInPandas(
        FeatureState(), outputStructType=OUTPUT, outputMode="Update", timeMode="None", initialState=initial
    )


def newest_rows(written: DataFrame, batch: str = "batch") -> DataFrame:
    """The feature row of each (zone, hour) from the last batch that wrote one."""
    columns = [c for c in written.columns if c not in (batch, "status")]
    rows = written.filter(F.col("status") == ROW).groupBy("zone", "datetime").agg(F.max_by(F.struct(*columns), batch).alias("_row"))
    return rows.select("_row.*")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
