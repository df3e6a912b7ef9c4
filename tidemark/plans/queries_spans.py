"""Queries over overlapping spans, time-ordered folds and stored profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import folds, overlap, schedule, sketches
from tidemark.plans.canonical import RUNS, Tables
from tidemark.plans.queries_live import FIT_ROWS, MODEL_SQL, SMALL, TARGETS, divided, matrix_columns, model_table
from tidemark.plans.queries_series import WINDOWS_SQL
from tidemark.plans.registry import query
from tidemark.session import written

# --- overlaps --------------------------------------------------------------------------------

# A job may run from the start of its day for its runtime and flexibility.
SPANS_SQL = f"""w AS (SELECT zone, start_time, end_time + INTERVAL 1 HOUR AS stop_time FROM ({WINDOWS_SQL})),
j AS (SELECT job_id, zone, CAST(run AS TIMESTAMP) AS may_start, CAST(run AS TIMESTAMP) + to_hours(CAST(runtime_hours + flexibility_hours AS INTEGER)) AS must_stop FROM jobs),
pairs AS (SELECT job_id, start_time, (epoch_us(least(must_stop, stop_time)) - epoch_us(greatest(may_start, start_time))) / 3600e6 AS overlap_hours
  FROM j JOIN w ON j.zone = w.zone AND may_start < stop_time AND start_time < must_stop)"""
JOB, WINDOW = ("may_start", "must_stop"), ("start_time", "stop_time")


def job_spans(t: Tables) -> DataFrame:
    start = F.col("run").cast("timestamp")
    hours = F.make_dt_interval(F.lit(0), (F.col("runtime_hours") + F.col("flexibility_hours")).cast("int"))
    return t.jobs.select("job_id", "zone", start.alias("may_start"), (start + hours).alias("must_stop"))


def window_spans(t: Tables) -> DataFrame:
    windows = schedule.green_windows(schedule.mark_green(t.forecasts, RUNS), RUNS)
    return windows.select("zone", "start_time", (F.col("end_time") + F.expr("INTERVAL 1 HOUR")).alias("stop_time"))


@query("j10_overlap_pairs", f"WITH {SPANS_SQL} SELECT * FROM pairs", floats="overlap_hours", ctes="forecasts jobs")
def _(t: Tables) -> DataFrame:
    """Each job with every low window of its zone that it may use, of the next days' forecasts too."""
    pairs = overlap.overlaps(job_spans(t), window_spans(t), ["zone"], JOB, WINDOW)
    return pairs.select("job_id", "start_time", (F.col("overlap_seconds") / 3600).alias("overlap_hours"))


@query(
    "j10_overlap_hours",
    f"WITH {SPANS_SQL} SELECT job_id, count(overlap_hours) AS windows, coalesce(sum(overlap_hours), 0) AS overlap_hours FROM j LEFT JOIN pairs USING (job_id) GROUP BY job_id",
    floats="overlap_hours",
    ctes="forecasts jobs",
)
def _(t: Tables) -> DataFrame:
    totals = overlap.overlap_totals(job_spans(t), window_spans(t), ["zone"], ["job_id"], JOB, WINDOW)
    return totals.select("job_id", F.col("overlapping").alias("windows"), (F.col("overlap_seconds") / 3600).alias("overlap_hours"))


# --- folds -----------------------------------------------------------------------------------

FOLDS, HORIZON = 3, 12
FOLDS_SQL = f"""{MODEL_SQL}, lab12 AS (SELECT datetime AS dt, actual FROM long WHERE split = 'train' AND horizon_hours = {HORIZON} AND actual IS NOT NULL),
span AS (SELECT min(epoch_us(dt)) AS lo, max(epoch_us(dt)) AS hi FROM lab12),
parts AS (SELECT CAST(f AS INTEGER) AS fold, lo + ((hi - lo) * f) // {FOLDS + 1} AS start, CASE WHEN f < {FOLDS} THEN lo + ((hi - lo) * (f + 1)) // {FOLDS + 1} END AS stop FROM span, range(1, {FOLDS + 1}) r(f)),
placed AS (SELECT fold, dt, actual, CASE WHEN epoch_us(dt) >= start AND (stop IS NULL OR epoch_us(dt) < stop) THEN 'test' WHEN epoch_us(dt) + {HORIZON} * 3600000000 <= start THEN 'train' END AS role FROM lab12, parts)"""


@query(
    "m8_fold_rows",
    f"{FOLDS_SQL} SELECT fold, role, count(*) AS n, min(dt) AS first_time, max(dt) AS last_time, avg(actual) AS mean_actual FROM placed WHERE role IS NOT NULL GROUP BY fold, role",
    floats="mean_actual",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Rows of the rolling folds: training ends the horizon before each test part."""
    label = TARGETS[HORIZON]
    train = divided(model_table(t))[0].dropna(subset=[label]).select("datetime", label)
    placed = folds.rolling_folds(train, "datetime", FOLDS, HORIZON * 3600)
    return placed.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"), F.avg(label).alias("mean_actual")
    )


POINTS = {"depth": (1, 3), "step": (0.1,)}


@query(
    "m8_rolling_origin",
    f"""{FOLDS_SQL}, score AS (SELECT count(DISTINCT fold) AS folds, count(*) AS rows_scored, avg(actual) AS mean_actual FROM placed WHERE role = 'test')
SELECT setting, CAST(folds AS INTEGER) AS folds, rows_scored, mean_actual, true AS learned FROM score, (VALUES {', '.join(f"('{s}')" for s in folds.one_at_a_time(SMALL, POINTS))}) v(setting)""",
    floats="mean_actual",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Errors of the settings over all rows of the test parts, and that they are below those of always saying 0."""
    label = TARGETS[HORIZON]
    train = divided(model_table(t))[0]
    found = folds.rolling_errors(
        train, matrix_columns(train), label, folds.one_at_a_time(SMALL, POINTS), "datetime", HORIZON * 3600, ["zone", "datetime"], FOLDS, FIT_ROWS, "weight"
    )
    return found.select("setting", "folds", "rows_scored", "mean_actual", ((F.col("mae") > 0) & (F.col("mae") < F.col("mean_actual"))).alias("learned"))


# --- stored profiles -------------------------------------------------------------------------

PROFILED = ("user_id", "whole")
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.06


@query(
    "a19_merged_profile",
    """WITH l AS (SELECT zone, 'user_id' AS feature, CAST(user_id AS DOUBLE) AS v FROM readings UNION ALL SELECT zone, 'whole', CAST(whole AS DOUBLE) FROM readings)
SELECT zone, feature, count(*) AS rows, count(v) AS n, avg(CAST(v IS NULL AS INTEGER)) AS null_rate, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS smallest, max(v) AS largest,
  true AS distinct_close, true AS median_close FROM l GROUP BY zone, feature""",
    floats="null_rate mean std smallest largest",
    digits=5,
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    """Profiles of a zone merged from those of its days, and whether their estimates keep the stated bounds on the rows themselves."""
    days = sketches.sketch_table(t.readings.withColumn("day", F.to_date("datetime")), ["zone", "day"], PROFILED)
    stored = written(days, "profiles")
    profile = sketches.sketched_profile(sketches.merge_sketches(stored, ["zone"]), ["zone"], {"median": 0.5})
    # Counted values, not rows, meet the profile.
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in PROFILED])
    counted = t.readings.select("zone", F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("zone", "feature", "value").agg(F.count(F.lit(1)).alias("held"))
    ranks = (
        counted.join(profile.select("zone", "feature", "median"), ["zone", "feature"])
        .groupBy("zone", "feature")
        .agg(
            F.count(F.lit(1)).alias("exact_distinct"),
            (F.sum(F.when(F.col("value") < F.col("median"), F.col("held")).otherwise(0)) / F.sum("held")).alias("below"),
            (F.sum(F.when(F.col("value") <= F.col("median"), F.col("held")).otherwise(0)) / F.sum("held")).alias("upto"),
        )
    )
    close = F.abs(F.col("distinct") - F.col("exact_distinct")) <= DISTINCT_ERROR * F.col("exact_distinct")
    ranked = (F.col("below") - RANK_ERROR <= 0.5) & (F.col("upto") + RANK_ERROR >= 0.5)
    return profile.join(ranks, ["zone", "feature"]).select(
        "zone", "feature", "rows", "n", "null_rate", "mean", "std", "smallest", "largest", close.alias("distinct_close"), ranked.alias("median_close")
    )
