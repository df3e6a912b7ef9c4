"""Queries over windows, joins on the series, and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clean, features, profile, schedule, series, split
from tidemark.plans.canonical import GRID_VALUES, HOURLY, RUNS, WEATHER_VALUES, Tables
from tidemark.plans.registry import query

CI, LOAD = GRID_VALUES[0], GRID_VALUES[4]
TEMP, WIND = WEATHER_VALUES[0], WEATHER_VALUES[1]
ROWS = "PARTITION BY zone ORDER BY datetime"


# --- joins -----------------------------------------------------------------------

SIGNALS = {
    "carbon-intensity": CI,
    "carbon-free-energy": GRID_VALUES[1],
    "total-load": LOAD,
    "renewable-energy": GRID_VALUES[3],
    "fossil-carbon-intensity": GRID_VALUES[2],
    "net-load": GRID_VALUES[5],
}


def signal_readings(t: Tables) -> DataFrame:
    """Long (zone, datetime, signal, value) readings, several per hour."""
    pairs = F.array(
        F.struct(F.lit("carbon-intensity").alias("signal"), F.col("whole").cast("double").alias("value")),
        F.when(F.col("k") < 50, F.struct(F.lit("carbon-free-energy").alias("signal"), F.col("k").cast("double").alias("value"))),
        F.when(
            F.col("user_id") > 20,
            F.struct(F.lit("total-load").alias("signal"), F.col("user_id").cast("double").alias("value")),
        ),
        F.when(F.col("k") >= 30, F.struct(F.lit("renewable-energy").alias("signal"), F.col("k").cast("double").alias("value"))),
        F.when(F.col("whole") > 10, F.struct(F.lit("fossil-carbon-intensity").alias("signal"), F.col("whole").cast("double").alias("value"))),
        F.when(F.col("user_id") <= 60, F.struct(F.lit("net-load").alias("signal"), F.col("user_id").cast("double").alias("value"))),
    )
    return t.readings.select("zone", "datetime", "event_id", F.inline(F.array_compact(pairs)))


SIGNAL_SQL = """
signals AS (
  SELECT zone, datetime, event_id, 'carbon-intensity' AS signal, CAST(whole AS DOUBLE) AS value FROM readings
  UNION ALL SELECT zone, datetime, event_id, 'carbon-free-energy', CAST(k AS DOUBLE) FROM readings WHERE k < 50
  UNION ALL SELECT zone, datetime, event_id, 'total-load', CAST(user_id AS DOUBLE) FROM readings WHERE user_id > 20
  UNION ALL SELECT zone, datetime, event_id, 'renewable-energy', CAST(k AS DOUBLE) FROM readings WHERE k >= 30
  UNION ALL SELECT zone, datetime, event_id, 'fossil-carbon-intensity', CAST(whole AS DOUBLE) FROM readings WHERE whole > 10
  UNION ALL SELECT zone, datetime, event_id, 'net-load', CAST(user_id AS DOUBLE) FROM readings WHERE user_id <= 60),
firsts AS (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY zone, datetime, signal ORDER BY event_id) = 1),
a AS (SELECT zone, datetime, value AS carbon_intensity_gco2_per_kwh FROM firsts WHERE signal = 'carbon-intensity'),
b AS (SELECT zone, datetime, value AS carbon_free_energy_pct FROM firsts WHERE signal = 'carbon-free-energy'),
c AS (SELECT zone, datetime, value AS total_load_mw FROM firsts WHERE signal = 'total-load'),
d AS (SELECT zone, datetime, value AS renewable_energy_pct FROM firsts WHERE signal = 'renewable-energy'),
e AS (SELECT zone, datetime, value AS carbon_intensity_fossil_gco2_per_kwh FROM firsts WHERE signal = 'fossil-carbon-intensity'),
f AS (SELECT zone, datetime, value AS net_load_mw FROM firsts WHERE signal = 'net-load')
"""
SIGNAL_JOIN_SQL = f"WITH {SIGNAL_SQL} SELECT * FROM a FULL JOIN b USING (zone, datetime) FULL JOIN c USING (zone, datetime) FULL JOIN d USING (zone, datetime) FULL JOIN e USING (zone, datetime) FULL JOIN f USING (zone, datetime)"


@query("j1_signal_full_outer", SIGNAL_JOIN_SQL, ctes="readings")
def _(t: Tables) -> DataFrame:
    return clean.pivot_signals(signal_readings(t), SIGNALS, ["event_id"])


@query("j1_signal_chained_join", SIGNAL_JOIN_SQL, ctes="readings")
def _(t: Tables) -> DataFrame:
    firsts = clean.keep_first(signal_readings(t), ["zone", "datetime", "signal"], ["event_id"])
    return clean.join_signals(
        [firsts.filter(F.col("signal") == s).select("zone", "datetime", F.col("value").alias(c)) for s, c in SIGNALS.items()]
    )


@query("j2_hourly_axis", "SELECT * FROM axis", ctes="axis")
def _(t: Tables) -> DataFrame:
    return t.grid_axis


@query("j3_grid_weather_inner", "SELECT * FROM observed JOIN weather USING (zone, datetime)", ctes="observed weather")
def _(t: Tables) -> DataFrame:
    return clean.merge_on_key(t.grid_observed, t.weather)


@query(
    "j3_merge_loss",
    """SELECT w.zone, count(*) AS left_rows, count(o.zone) AS merged_rows, count(*) - count(o.zone) AS lost_rows,
  (count(*) - count(o.zone)) / count(*) * 100 AS lost_pct
FROM weather w LEFT JOIN observed o ON w.zone = o.zone AND w.datetime = o.datetime GROUP BY w.zone""",
    floats="lost_pct",
    ctes="observed weather",
)
def _(t: Tables) -> DataFrame:
    return clean.merge_loss(t.weather, t.grid_observed)


@query(
    "j3_unmatched",
    f"""SELECT w.zone, w.datetime FROM weather w
ANTI JOIN (SELECT * FROM observed WHERE {CI} >= 100) o ON w.zone = o.zone AND w.datetime = o.datetime""",
    ctes="observed weather",
)
def _(t: Tables) -> DataFrame:
    """Weather hours without a grid hour above the lowest level."""
    return clean.unmatched(t.weather.select("zone", "datetime"), t.grid_observed.filter(F.col(CI) >= 100))


SPLIT_SQL = """CASE WHEN datetime <= TIMESTAMP '1999-06-30 23:00:00' THEN 'train'
  WHEN datetime <= TIMESTAMP '2000-06-30 23:00:00' THEN 'val' ELSE 'test' END"""


@query(
    "j4_zone_hour_mean",
    """WITH means AS (SELECT zone, hour(datetime) AS hour_of_day, avg(carbon_intensity_gco2_per_kwh) AS hist_mean
  FROM observed WHERE datetime <= TIMESTAMP '2024-01-20' GROUP BY 1, 2)
SELECT o.zone, o.datetime, CAST(hour(o.datetime) AS INTEGER) AS hour_of_day, o.carbon_intensity_gco2_per_kwh, hist_mean
FROM observed o LEFT JOIN means m ON o.zone = m.zone AND hour(o.datetime) = m.hour_of_day
WHERE o.datetime > TIMESTAMP '2024-01-20'""",
    floats="hist_mean",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    border = F.lit("2024-01-20").cast("timestamp")
    seen = t.grid_observed.select("zone", "datetime", CI)
    means = split.zone_hour_means(seen.filter(F.col("datetime") <= border))
    return split.with_zone_hour_mean(seen.filter(F.col("datetime") > border), means)


@query(
    "j5_hour_mean_lookup",
    """SELECT zone, datetime, carbon_intensity_gco2_per_kwh,
  avg(carbon_intensity_gco2_per_kwh) OVER (PARTITION BY hour(datetime)) AS pred_historical_mean FROM grid""",
    floats="pred_historical_mean",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return split.with_series_baselines(t.grid.select("zone", "datetime", CI)).select("zone", "datetime", CI, "pred_historical_mean")


# --- windows ----------------------------------------------------------------------

LAGS = (1, 3, 6, 24, 168)


@query(
    "w1_lags",
    "SELECT zone, datetime, "
    + ", ".join(f"lag({c}, {n}) OVER ({ROWS}) AS {c}_lag_{n}h" for c in (CI, LOAD, TEMP, WIND) for n in LAGS)
    + " FROM merged",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    lagged = features.add_lag_features(t.merged, HOURLY, [CI, LOAD, TEMP, WIND], LAGS)
    return lagged.drop(*GRID_VALUES, *WEATHER_VALUES)


@query(
    "w2_leads",
    "SELECT zone, datetime, "
    + ", ".join(f"lead({CI}, {h}) OVER ({ROWS}) AS carbon_intensity_target_{h}h" for h in (1, 6, 12, 24))
    + " FROM grid",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return features.add_targets(t.grid, HOURLY).drop(*GRID_VALUES)


ROLLED = [f"{c}_{s}_{n}h" for c in (CI, LOAD, TEMP) for n in (4, 12, 24) for s in ("mean", "std", "min", "max")]


def _rolling_sql(column: str, stat: str, n: int) -> str:
    function = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[stat]
    return f"{function}({column}) OVER ({ROWS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    "w3_rolling",
    "SELECT zone, datetime, "
    + ", ".join(
        f"{_rolling_sql(c, s, n)} AS {c}_{s}_{n}h"
        for c in (CI, LOAD, TEMP)
        for n in (4, 12, 24)
        for s in ("mean", "std", "min", "max")
    )
    + " FROM merged",
    floats=" ".join(ROLLED),
    digits=5,
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    rolled = features.add_rolling_features(t.merged, HOURLY, features.TRAIN.rolling)
    return rolled.drop(*GRID_VALUES, *WEATHER_VALUES)


STEPPED = f"CASE WHEN datetime < TIMESTAMP '2024-01-08' THEN {CI} % 10 ELSE {CI} + 1e9 END"


@query(
    "w3_rolling_after_step",
    "SELECT zone, datetime, "
    + ", ".join(_rolling_sql("v", s, n) + f" AS v_{s}_{n}h" for n in (4, 12, 17, 24) for s in ("mean", "std", "min", "max"))
    + f" FROM (SELECT zone, datetime, {STEPPED} AS v FROM grid)",
    floats=" ".join(f"v_{s}_{n}h" for n in (4, 12, 17, 24) for s in ("mean", "std")),
    digits=2,
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    """Values that jump from below 10 to above 1e9."""
    stepped = t.grid.select("zone", "datetime", F.expr(STEPPED.replace("1e9", "1e9D")).alias("v"))
    return features.add_rolling_features(stepped, HOURLY, {"v": {n: features.ALL_STATS for n in (4, 12, 17, 24)}}).drop("v")


@query(
    "w4_full_window_std",
    f"""SELECT zone, datetime, CASE WHEN count({LOAD}) OVER w = 24 THEN stddev_samp({LOAD}) OVER w ELSE 0.0 END AS load_variability
FROM grid WINDOW w AS ({ROWS} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
    floats="load_variability",
    digits=5,
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return series.in_chunks(
        t.grid, HOURLY, 23, 0, lambda rows, w: features.full_window_std(rows, HOURLY.over(), LOAD, 24, "load_variability")
    ).select("zone", "datetime", "load_variability")


@query(
    "w5_first_difference",
    f"SELECT zone, datetime, coalesce({CI} - lag({CI}) OVER ({ROWS}), 0) AS carbon_change_1h FROM grid",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return series.bounded_window(t.grid, HOURLY, 1, 0, lambda w: {"carbon_change_1h": features.change_column(w, CI)}).select(
        "zone", "datetime", "carbon_change_1h"
    )


GAPS_SQL = f"""SELECT zone, datetime, previous_time, CAST(epoch(datetime) - epoch(previous_time) AS BIGINT) AS step_seconds
FROM (SELECT zone, datetime, lag(datetime) OVER ({ROWS}) AS previous_time FROM observed)
WHERE previous_time IS NOT NULL AND epoch(datetime) - epoch(previous_time) <> 3600"""


@query("w6_gaps", GAPS_SQL, ctes="observed")
def _(t: Tables) -> DataFrame:
    return profile.step_gaps(t.grid_observed)


@query(
    "w6_regularity",
    f"""SELECT o.zone, o.rows, coalesce(g.n, 0) AS irregular_steps, coalesce(g.longest, 3600) AS longest_step, g.n IS NULL AS is_regular
FROM (SELECT zone, count(*) AS rows FROM observed GROUP BY zone) o
LEFT JOIN (SELECT zone, count(*) AS n, max(step_seconds) AS longest FROM ({GAPS_SQL}) GROUP BY zone) g ON o.zone = g.zone""",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return profile.regularity(t.grid_observed)


@query(
    "w7_keep_first",
    """SELECT zone, datetime, event_id, user_id, whole FROM readings
QUALIFY row_number() OVER (PARTITION BY zone, datetime ORDER BY ts, event_id) = 1""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return clean.keep_first(
        t.readings.select("zone", "datetime", "event_id", "user_id", "whole", "ts"), ["zone", "datetime"], ["ts", "event_id"]
    ).drop("ts")


@query(
    "w7_duplicate_count",
    """SELECT count(*) AS rows_before, count(DISTINCT (zone, datetime)) AS rows_after,
  count(*) - count(DISTINCT (zone, datetime)) AS removed FROM readings""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return clean.duplicate_count(t.readings, ["zone", "datetime"])


@query("w8_forward_backward_fill", "SELECT * FROM grid", ctes="grid")
def _(t: Tables) -> DataFrame:
    return series.fill_nulls(t.grid_axis, HOURLY, GRID_VALUES)


@query("w8_axis_and_fill", "SELECT * FROM grid", ctes="grid")
def _(t: Tables) -> DataFrame:
    """Axis and fill in one plan; chunks of 12 hours leave whole chunks without readings."""
    return series.regularise_and_fill(t.grid_observed, series.Series(chunk_steps=12), GRID_VALUES)


@query(
    "w9_backward_forward_fill",
    "SELECT zone, datetime, "
    + ", ".join(
        f"""coalesce(first_value({c} IGNORE NULLS) OVER ({ROWS} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value({c} IGNORE NULLS) OVER ({ROWS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}"""
        for c in GRID_VALUES
    )
    + " FROM axis",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    return series.fill_nulls(t.grid_axis, HOURLY, GRID_VALUES, ("backward", "forward"), 0.0)


@query("w10_serve_fill", "SELECT * FROM grid", ctes="grid")
def _(t: Tables) -> DataFrame:
    """Serving fill, kept within each zone; chunks of two days exercise the carry."""
    return series.fill_nulls(t.grid_axis, series.Series(chunk_steps=48), GRID_VALUES, ("forward", "backward"))


@query(
    "w11_persistence",
    f"SELECT zone, datetime, lag({CI}) OVER ({ROWS}) AS pred_persistence_1h FROM grid",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return split.with_series_baselines(t.grid.select("zone", "datetime", CI)).select("zone", "datetime", "pred_persistence_1h")


@query(
    "w11_persistence_across_zones",
    f"SELECT zone, datetime, lag({CI}) OVER (ORDER BY zone, datetime) AS pred_persistence_1h FROM grid",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return split.with_series_baselines(t.grid.select("zone", "datetime", CI), across_zones=True).select(
        "zone", "datetime", "pred_persistence_1h"
    )


@query(
    "w12_latest_rows",
    "SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY zone ORDER BY datetime DESC) <= 24",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return series.latest_rows(t.grid, HOURLY, 24)


GREEN = """limits AS (SELECT zone, run, quantile_cont(predicted_carbon_intensity, 0.25) AS threshold FROM forecasts GROUP BY zone, run),
marked AS (SELECT f.*, threshold, predicted_carbon_intensity <= threshold AS is_green FROM forecasts f JOIN limits USING (zone, run))"""
WINDOWS_SQL = f"""WITH {GREEN},
steps AS (SELECT *, CASE WHEN is_green AND NOT coalesce(lag(is_green) OVER (PARTITION BY zone, run ORDER BY datetime), false) THEN 1 ELSE 0 END AS opened FROM marked),
numbered AS (SELECT *, sum(opened) OVER (PARTITION BY zone, run ORDER BY datetime) AS island FROM steps)
SELECT zone, run, min(datetime) AS start_time, max(datetime) AS end_time, count(*) AS duration_hours,
  round_even(avg(predicted_carbon_intensity), 2) AS avg_intensity, round_even(min(predicted_carbon_intensity), 2) AS min_intensity,
  round_even(max(predicted_carbon_intensity), 2) AS max_intensity
FROM numbered WHERE is_green GROUP BY zone, run, island"""


@query("w13_green_windows", WINDOWS_SQL, floats="avg_intensity min_intensity max_intensity", ctes="forecasts")
def _(t: Tables) -> DataFrame:
    return schedule.green_windows(schedule.mark_green(t.forecasts, RUNS), RUNS)


@query(
    "w13_long_green_windows",
    """WITH limits AS (SELECT zone, quantile_cont(predicted_carbon_intensity, 0.25) AS threshold FROM forecasts GROUP BY zone),
marked AS (SELECT f.*, predicted_carbon_intensity <= threshold AS is_green FROM forecasts f JOIN limits USING (zone)),
steps AS (SELECT *, CASE WHEN is_green AND NOT coalesce(lag(is_green) OVER (PARTITION BY zone ORDER BY datetime), false) THEN 1 ELSE 0 END AS opened FROM marked),
numbered AS (SELECT *, sum(opened) OVER (PARTITION BY zone ORDER BY datetime) AS island FROM steps)
SELECT zone, min(datetime) AS start_time, max(datetime) AS end_time, count(*) AS duration_hours,
  round_even(avg(predicted_carbon_intensity), 2) AS avg_intensity, round_even(min(predicted_carbon_intensity), 2) AS min_intensity,
  round_even(max(predicted_carbon_intensity), 2) AS max_intensity
FROM numbered WHERE is_green GROUP BY zone, island""",
    floats="avg_intensity min_intensity max_intensity",
    ctes="forecasts",
)
def _(t: Tables) -> DataFrame:
    """Runs across chunk borders: the whole month is one forecast."""
    long = series.Series(chunk_steps=48)
    return schedule.green_windows(schedule.mark_green(t.forecasts.drop("run"), long), long)


@query(
    "w14_best_start",
    """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY zone, run ORDER BY datetime) - 1 AS pos FROM forecasts),
means AS (SELECT zone, run, datetime, pos, avg(predicted_carbon_intensity) OVER w AS mean_intensity, count(*) OVER w AS n
  FROM placed WINDOW w AS (PARTITION BY zone, run ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT zone, run, pos AS hours_to_wait, datetime AS recommended_start, mean_intensity AS expected_intensity,
  first_value(mean_intensity) OVER (PARTITION BY zone, run ORDER BY pos) AS immediate_intensity
FROM means WHERE n = 3 AND pos <= 12
QUALIFY row_number() OVER (PARTITION BY zone, run ORDER BY mean_intensity, pos) = 1""",
    floats="expected_intensity immediate_intensity",
    ctes="forecasts",
)
def _(t: Tables) -> DataFrame:
    jobs = t.forecasts.select("zone", "run").distinct().withColumns(
        {"runtime_hours": F.lit(3), "flexibility_hours": F.lit(12).cast("long"), "energy_kwh": F.lit(100.0)}
    )
    options = schedule.start_options(t.forecasts, RUNS, [3])
    # The last start a run allows, up to 12 hours of patience.
    best = options.filter(F.col("max_start") <= 12).groupBy("zone", "run").agg(
        F.max_by(F.struct("hours_to_wait", "recommended_start", "expected_intensity", "immediate_intensity"), "max_start").alias("b")
    )
    return jobs.join(best, ["zone", "run"]).select("zone", "run", "b.*")


@query(
    "w15_middle_rows",
    """SELECT zone, datetime, carbon_intensity_gco2_per_kwh FROM (
  SELECT *, row_number() OVER (PARTITION BY zone ORDER BY datetime) - 1 AS p, count(*) OVER (PARTITION BY zone) AS n FROM observed)
WHERE p >= n // 2 AND p < n // 2 + 24""",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return series.middle_rows(t.grid_observed.select("zone", "datetime", CI), series.Series(chunk_steps=100), 24)


@query(
    "w18_window_around_minimum",
    """WITH placed AS (SELECT *, row_number() OVER (PARTITION BY zone, run ORDER BY datetime) - 1 AS pos FROM forecasts),
low AS (SELECT zone, run, predicted_carbon_intensity AS lowest, pos AS low_index FROM placed
  QUALIFY row_number() OVER (PARTITION BY zone, run ORDER BY predicted_carbon_intensity, pos) = 1)
SELECT *, greatest(low_index - 1, 0) AS start_index, least(low_index + 2, 23) AS end_index FROM low""",
    ctes="forecasts",
)
def _(t: Tables) -> DataFrame:
    return schedule.window_around_minimum(t.forecasts, RUNS)


@query(
    "w1_positional_lag_irregular",
    f"SELECT zone, datetime, lag({CI}, 3) OVER ({ROWS}) AS previous_3 FROM observed",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    """Row-counted lag on a series with gaps."""
    placed, counted = series.dense(t.grid_observed, series.Series(chunk_steps=64))
    return series.bounded_window(placed, counted, 3, 0, lambda w: {"previous_3": F.lag(CI, 3).over(w)}).select(
        "zone", "datetime", "previous_3"
    )
