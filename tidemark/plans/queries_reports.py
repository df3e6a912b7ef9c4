"""Queries over aggregates, quality checks, model decisions and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import buckets
from tidemark.functions.scalars import signed_percent
from tidemark.operators import decisions, distance, features, metrics, profile, quality, ranks, resample, schedule, split
from tidemark.operators.series import bounded_window
from tidemark.plans.canonical import GRID_VALUES, HOURLY, RUNS, TRAIN_END, VAL_END, Tables
from tidemark.plans.queries_tables import LEVEL_INDEX_SQL, LEVEL_SQL, REPORT_LEVEL_SQL, SEASON_SQL, SPLIT_CASE
from tidemark.plans.registry import query

CI, CFE, REN, LOAD = GRID_VALUES[0], GRID_VALUES[1], GRID_VALUES[3], GRID_VALUES[4]
PAIR = ["model", "horizon_hours"]

# --- distributions and statistics ----------------------------------------------------

SLICED_SQL = f"""sliced AS (SELECT zone, datetime, {CI}, unnest(['hour_of_day', 'day_of_week', 'season', 'month', 'is_weekend', 'carbon_intensity_bucket']) AS slice,
  unnest([CAST(hour(datetime) AS VARCHAR), dayname(datetime), {SEASON_SQL}, CAST(month(datetime) AS VARCHAR),
    CASE WHEN isodow(datetime) >= 6 THEN 'True' ELSE 'False' END, {REPORT_LEVEL_SQL.format(c=CI)}]) AS slice_value FROM daily)"""
DISTRIBUTION_SQL = """SELECT slice, slice_value, n AS count, percentage, round_even(expected, 2) AS expected_pct,
  round_even((percentage - expected) / expected * 100, 2) AS deviation_pct,
  percentage < expected * 0.5 AS is_underrepresented, percentage > expected * 1.5 AS is_overrepresented
FROM (SELECT slice, slice_value, n, round_even(n / sum(n) OVER (PARTITION BY slice) * 100, 2) AS percentage,
  100.0::DOUBLE / count(*) OVER (PARTITION BY slice) AS expected
  FROM (SELECT slice, slice_value, count(*) AS n FROM sliced GROUP BY slice, slice_value))"""
DISTRIBUTION_FLOATS = "percentage expected_pct deviation_pct"


def sliced(t: Tables) -> DataFrame:
    return profile.add_slices(t.daily_observed, CI)


@query("a1_slice_distribution", f"WITH {SLICED_SQL} SELECT * FROM ({DISTRIBUTION_SQL}) WHERE slice = 'carbon_intensity_bucket'", floats=DISTRIBUTION_FLOATS, ctes="daily")
def _(t: Tables) -> DataFrame:
    return profile.slice_distribution(sliced(t), ["carbon_intensity_bucket"])


STATS_SQL = f"""SELECT slice, slice_value, count({CI}) AS count, round_even(avg({CI}), 2) AS mean, round_even(stddev_samp({CI}), 2) AS std,
  round_even(min({CI}), 2) AS min, round_even(max({CI}), 2) AS max,
  round_even(avg(CAST({CI} IS NULL AS INTEGER)) * 100, 2) AS missing_pct, round_even(median({CI}), 2) AS median
FROM sliced GROUP BY slice, slice_value"""


@query("a2_slice_target_stats", f"WITH {SLICED_SQL} SELECT * FROM ({STATS_SQL}) WHERE slice = 'season'", floats="mean std min max missing_pct median", ctes="daily")
def _(t: Tables) -> DataFrame:
    return profile.slice_target_stats(sliced(t), ["season"], CI)


@query("a3_all_slice_distributions", f"WITH {SLICED_SQL} {DISTRIBUTION_SQL}", floats=DISTRIBUTION_FLOATS, ctes="daily")
def _(t: Tables) -> DataFrame:
    return profile.slice_distribution(sliced(t), profile.SLICES)


@query("a3_all_slice_target_stats", f"WITH {SLICED_SQL} {STATS_SQL}", floats="mean std min max missing_pct median", ctes="daily")
def _(t: Tables) -> DataFrame:
    return profile.slice_target_stats(sliced(t), profile.SLICES, CI)


@query("a4_zone_hour_means", f"SELECT zone, CAST(hour(datetime) AS INTEGER) AS hour_of_day, avg({CI}) AS hist_mean FROM observed GROUP BY 1, 2", floats="hist_mean", ctes="observed")
def _(t: Tables) -> DataFrame:
    return split.zone_hour_means(t.grid_observed)


def scores_sql(by: str, source: str = "scores", digits: int = 4) -> str:
    return f"""SELECT {by}, round_even(avg(abs(e)), {digits}) AS mae, round_even(sqrt(avg(e * e)), {digits}) AS rmse,
  round_even(1 - sum(e * e) / nullif(var_pop(y) * count(y), 0), {digits}) AS r2, round_even(avg(abs(e / (y + 1e-8))) * 100, {digits}) AS mape
FROM (SELECT *, CASE WHEN predicted IS NOT NULL THEN actual END AS y, actual - predicted AS e FROM {source}) GROUP BY {by}"""


@query("a5_scores", scores_sql("model, horizon_hours"), floats="mae rmse r2 mape", ctes="scores")
def _(t: Tables) -> DataFrame:
    return metrics.scores(t.scores, PAIR)


@query(
    "a6_baseline_scores",
    """SELECT model, round_even(avg(abs(e)), 2) AS mae, round_even(sqrt(avg(e * e)), 2) AS rmse, round_even(avg(abs(e / nullif(actual, 0))) * 100, 2) AS mape
FROM (SELECT *, actual - predicted AS e FROM scores) GROUP BY model""",
    floats="mae rmse mape",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return metrics.baseline_scores(t.scores, ["model"])


@query(
    "a7_coverage",
    """SELECT zone, count(*) AS rows, min(datetime) AS first_time, max(datetime) AS last_time, count(*) / sum(count(*)) OVER () * 100 AS share_pct FROM observed GROUP BY zone""",
    floats="share_pct",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return profile.coverage(t.grid_observed)


def _summary_sql(columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, stddev_samp({c}) AS std, count(*) - count({c}) AS nulls FROM axis"""
        for c in columns
    )


@query("a8_value_summary", _summary_sql([CI, CFE, REN, LOAD]), floats="mean std", digits=4, ctes="axis")
def _(t: Tables) -> DataFrame:
    return profile.value_summary(t.grid_axis, [CI, CFE, REN, LOAD])


@query(
    "a9_null_counts",
    "\nUNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*) * 100 AS null_pct FROM axis""" for c in ("zone", "datetime", *GRID_VALUES)),
    floats="null_pct",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    return profile.null_counts(t.grid_axis)


@query(
    "a10_worst_null_rate",
    f"""SELECT zone, greatest(avg(CAST({CI} IS NULL AS INTEGER)), avg(CAST(nullif({CFE}, 0) IS NULL AS INTEGER))) AS max_null_rate FROM axis GROUP BY zone""",
    floats="max_null_rate",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    known = t.grid_axis.withColumn(CFE, F.nullif(F.col(CFE), F.lit(0.0)))
    return profile.worst_null_rate(known, [CI, CFE], ["zone"])


@query(
    "a11_imbalance",
    f"""WITH c AS (SELECT {LEVEL_SQL.format(c=CI)} AS b, count(*) AS n FROM axis GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS samples, max(n) / min(n) AS imbalance_ratio,
  CASE WHEN max(n) / min(n) <= 2 THEN 'LOW' WHEN max(n) / min(n) <= 5 THEN 'MODERATE' WHEN max(n) / min(n) <= 10 THEN 'HIGH' ELSE 'SEVERE' END AS severity
FROM c WHERE b <> 'Unknown'""",
    floats="imbalance_ratio",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    return profile.imbalance(t.grid_axis.select(buckets.level(F.col(CI)).alias("carbon_bucket")), "carbon_bucket")


@query(
    "a12_best_per_group",
    f"""SELECT horizon_hours, zone, mae FROM (SELECT horizon_hours, zone, avg(abs(actual - predicted)) AS mae FROM scores GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY horizon_hours ORDER BY mae, zone) = 1""",
    floats="mae",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    per_zone = t.scores.groupBy("horizon_hours", "zone").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    return metrics.best_per_group(per_zone, ["horizon_hours"], "mae", ["zone"])


RANGE_LEVEL_SQL = """CASE WHEN {c} < 0 THEN 'nan' WHEN {c} < 100 THEN 'Very Low (0-100)' WHEN {c} < 200 THEN 'Low (100-200)' WHEN {c} < 350 THEN 'Medium (200-350)'
  WHEN {c} < 500 THEN 'High (350-500)' ELSE 'Very High (500+)' END"""
SLICE_ROWS_SQL = f"""members AS (SELECT model, horizon_hours, actual, predicted, unnest(list_filter([
  {{'t': 'overall', 'v': 'all'}}, {{'t': 'zone', 'v': zone}}, {{'t': 'season', 'v': {SEASON_SQL}}}, {{'t': 'carbon_bucket', 'v': {RANGE_LEVEL_SQL.format(c='actual')}}},
  {{'t': 'weather_condition', 'v': CASE WHEN temperature_2m_c < 5 THEN 'Cold (< 5C)' WHEN temperature_2m_c < 20 THEN 'Mild (5-20C)' ELSE 'Hot (>= 20C)' END}},
  {{'t': 'weather_condition', 'v': CASE WHEN wind_speed_100m_ms >= 10 THEN 'Windy (>= 10 m/s)' ELSE 'Calm (< 10 m/s)' END}},
  {{'t': 'weather_condition', 'v': CASE WHEN cloud_cover_pct >= 75 THEN 'Overcast (>= 75%)' WHEN cloud_cover_pct < 25 THEN 'Clear (< 25%)' END}}], lambda x: x.v IS NOT NULL)) AS m FROM scores),
slices AS (SELECT model, horizon_hours, m.t AS slice_type, m.v AS slice_value, count(*) AS n_samples, round_even(avg(abs(actual - predicted)), 4) AS mae,
  round_even(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse,
  round_even(1 - sum((actual - predicted) * (actual - predicted)) / nullif(var_pop(actual) * count(actual), 0), 4) AS r2,
  round_even(avg(abs((actual - predicted) / (actual + 1e-8))) * 100, 4) AS mape
  FROM members GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10)"""
DISPARITY_SQL = """disparity AS (SELECT model, horizon_hours, slice_type, slice_value, n_samples, s.mae AS slice_mae, base AS baseline_mae,
  round_even((s.mae - base) / base, 4) AS relative_diff, printf('%+.1f%%', round_even((s.mae - base) / base * 100, 1)) AS pct_deviation, abs((s.mae - base) / base) > 0.20 AS flagged
  FROM slices s JOIN (SELECT model, horizon_hours, mae AS base FROM slices WHERE slice_type = 'overall') o USING (model, horizon_hours) WHERE slice_type <> 'overall')"""


def slices(t: Tables) -> DataFrame:
    return metrics.slice_scores(t.scores, PAIR)


@query("q11_slice_scores", f"WITH {SLICE_ROWS_SQL} SELECT * FROM slices", floats="mae rmse r2 mape", ctes="scores")
def _(t: Tables) -> DataFrame:
    return slices(t)


@query("q10_disparities", f"WITH {SLICE_ROWS_SQL}, {DISPARITY_SQL} SELECT * FROM disparity", floats="slice_mae baseline_mae relative_diff", ctes="scores")
def _(t: Tables) -> DataFrame:
    return metrics.disparities(slices(t), PAIR)


@query(
    "a13_slice_summary",
    f"""WITH {SLICE_ROWS_SQL}, {DISPARITY_SQL},
o AS (SELECT model, horizon_hours, mae AS overall_mae, rmse AS overall_rmse, r2 AS overall_r2 FROM slices WHERE slice_type = 'overall'),
z AS (SELECT model, horizon_hours, slice_value AS worst_zone, mae AS worst_zone_mae FROM slices WHERE slice_type = 'zone' QUALIFY row_number() OVER (PARTITION BY model, horizon_hours ORDER BY mae DESC, slice_value) = 1),
b AS (SELECT model, horizon_hours, slice_value AS worst_carbon_bucket, mae AS worst_carbon_bucket_mae FROM slices WHERE slice_type = 'carbon_bucket' QUALIFY row_number() OVER (PARTITION BY model, horizon_hours ORDER BY mae DESC, slice_value) = 1),
f AS (SELECT model, horizon_hours, count(*) FILTER (flagged) AS n_flagged_slices FROM disparity GROUP BY 1, 2)
SELECT * FROM o LEFT JOIN z USING (model, horizon_hours) LEFT JOIN b USING (model, horizon_hours) LEFT JOIN f USING (model, horizon_hours)""",
    floats="overall_mae overall_rmse overall_r2 worst_zone_mae worst_carbon_bucket_mae",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    table = slices(t)
    return metrics.slice_summary(table, metrics.disparities(table, PAIR), PAIR)


@query(
    "a14_bucket_confusion",
    f"""WITH seen AS (SELECT {LEVEL_INDEX_SQL.format(c='actual')} AS a, {LEVEL_INDEX_SQL.format(c='predicted')} AS p FROM scores WHERE actual >= 350)
SELECT CAST(g.l AS INTEGER) AS actual_level, """
    + ", ".join(f"count(*) FILTER (seen.p = {i}) AS predicted_{i}" for i in range(5))
    + " FROM generate_series(0, 4) g(l) LEFT JOIN seen ON seen.a = g.l GROUP BY g.l",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    """Scores of high values only: the lower levels have rows of zeros."""
    return metrics.bucket_confusion(t.scores.filter(F.col("actual") >= 350))


@query(
    "a15_forecast_threshold",
    "SELECT zone, run, quantile_cont(predicted_carbon_intensity, 0.25) AS threshold FROM forecasts GROUP BY zone, run",
    floats="threshold",
    ctes="forecasts",
)
def _(t: Tables) -> DataFrame:
    return ranks.quantile_columns(t.forecasts, ["zone", "run"], "predicted_carbon_intensity", {"threshold": 0.25})


@query(
    "a15_exact_quantiles",
    """SELECT event_type AS zone, unnest([0.1::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS quantile, unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.9])) AS value FROM events GROUP BY 1""",
    floats="value",
)
def _(t: Tables) -> DataFrame:
    """Quantiles of a column per zone, at every event."""
    values = t["events"].select(F.col("event_type").alias("zone"), "value")
    return ranks.exact_quantiles(values, ["zone"], "value", [0.1, 0.25, 0.5, 0.9], splits=64)


@query(
    "a16_green_summary",
    """WITH limits AS (SELECT zone, run, quantile_cont(predicted_carbon_intensity, 0.25) AS threshold FROM forecasts GROUP BY zone, run),
m AS (SELECT f.zone, f.run, threshold, predicted_carbon_intensity AS v, predicted_carbon_intensity <= threshold AS g FROM forecasts f JOIN limits USING (zone, run)),
s AS (SELECT zone, run, round_even(max(threshold), 2) AS threshold, count(*) FILTER (g) AS green_hours, count(*) AS total_hours,
  round_even(avg(v) FILTER (g), 2) AS avg_green, round_even(avg(v) FILTER (NOT g), 2) AS avg_red FROM m GROUP BY zone, run)
SELECT *, round_even(green_hours / total_hours * 100, 1) AS green_pct, CASE WHEN avg_red > 0 THEN round_even((avg_red - avg_green) / avg_red * 100, 1) END AS co2_savings_pct FROM s""",
    floats="threshold avg_green avg_red green_pct co2_savings_pct",
    ctes="forecasts",
)
def _(t: Tables) -> DataFrame:
    return schedule.green_summary(schedule.mark_green(t.forecasts, RUNS), ["zone", "run"])


@query(
    "a17_critical_count",
    """SELECT count(*) FILTER (abs(TRY_CAST(replace(replace(trim(p), '%', ''), '+', '') AS DOUBLE)) > 80) AS critical
FROM (SELECT CASE WHEN row_id % 7 = 0 THEN 'n/a' ELSE printf('%+.1f%%', round_even((predicted - actual) / 64 * 100, 1)) END AS p FROM scores)""",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("row_id") % 7 == 0, "n/a").otherwise(signed_percent((F.col("predicted") - F.col("actual")) / 64))
    return metrics.critical_count(t.scores.select(text.alias("pct_deviation")))


@query(
    "a18_dataset_info",
    f"""SELECT {SPLIT_CASE} AS split, count(*) AS rows, CAST(min(datetime) AS DATE) AS start_date, CAST(max(datetime) AS DATE) AS end_date, count(DISTINCT zone) AS n_zones FROM daily GROUP BY 1""",
    ctes="daily",
)
def _(t: Tables) -> DataFrame:
    return profile.dataset_info(split.assign_split(t.daily_observed, TRAIN_END, VAL_END))


@query("a18_zone_list", "SELECT DISTINCT zone FROM daily", ctes="daily")
def _(t: Tables) -> DataFrame:
    return profile.zone_list(t.daily_observed)


PROFILED = ("o_totalprice", "o_custkey")


@query(
    "a19_numeric_profile",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS nulls, count(*) FILTER ({c} = 0) AS zeros, CAST(min({c}) AS DOUBLE) AS min,
  CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, stddev_samp({c}) AS std, count(DISTINCT {c}) AS distinct, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median,
  quantile_cont({c}, 0.75) AS p75 FROM orders"""
        for c in PROFILED
    ),
    floats="mean std p25 median p75",
)
def _(t: Tables) -> DataFrame:
    return profile.numeric_profile(t["orders"], PROFILED)


@query(
    "a19_top_values",
    "\nUNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank
  FROM events GROUP BY {c}) WHERE rank <= 5"""
        for c in ("event_type", "user_id")
    ),
)
def _(t: Tables) -> DataFrame:
    return profile.top_values(t["events"], ["event_type", "user_id"])


@query(
    "a19_histogram",
    """SELECT 'user_id' AS "column", CAST(least(floor((user_id - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin, count(*) AS count
FROM events, (SELECT min(user_id)::DOUBLE AS lo, max(user_id)::DOUBLE AS hi FROM events) GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return profile.histogram(t["events"], ["user_id"])


@query(
    "a20_zone_target_stats",
    f"SELECT zone, avg({CI}) AS mean, stddev_samp({CI}) AS std, min({CI}) AS min, max({CI}) AS max, median({CI}) AS median FROM observed GROUP BY zone",
    floats="mean std median",
    digits=4,
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return profile.zone_target_stats(t.grid_observed, CI)


@query(
    "a22_lowest_zone",
    f"SELECT zone, m AS mean_intensity FROM (SELECT zone, avg({CI}) AS m FROM observed GROUP BY zone) ORDER BY m, zone LIMIT 1",
    floats="mean_intensity",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return schedule.lowest_zone(t.grid_observed.groupBy("zone").agg(F.avg(CI).alias("mean_intensity")), "mean_intensity")


@query(
    "a24_duplicate_times",
    """SELECT zone, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT zone, CASE WHEN k = 13 THEN NULL ELSE datetime END AS dt, count(*) AS n FROM readings GROUP BY 1, 2) GROUP BY zone""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    times = t.readings.select("zone", F.when(F.col("k") != 13, F.col("datetime")).alias("dt"))
    return times.groupBy("zone", "dt").agg((F.count(F.lit(1)) - 1).alias("_extra")).groupBy("zone").agg(F.sum("_extra").alias("duplicates"))


@query(
    "a25_rare_slice",
    """SELECT model, horizon_hours, count(*) FILTER (actual < 100) AS rare_rows, avg(abs(actual - predicted)) FILTER (actual < 100) AS rare_mae,
  avg(abs(actual - predicted)) AS overall_mae, (avg(abs(actual - predicted)) FILTER (actual < 100) - avg(abs(actual - predicted))) / nullif(avg(abs(actual - predicted)), 0) * 100 AS deviation_pct
FROM scores GROUP BY 1, 2""",
    floats="rare_mae overall_mae deviation_pct",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return metrics.rare_slice_check(t.scores, PAIR)


@query("a26_exact_distinct", "SELECT DISTINCT event_type, user_id, props FROM events")
def _(t: Tables) -> DataFrame:
    return profile.exact_distinct(t["events"].select("event_type", "user_id", "props"))


# --- before and after ------------------------------------------------------------------


def two_models(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Slice scores of the base and the tuned model at one horizon; the tuned one lacks some slices."""
    table = slices(t).filter(F.col("horizon_hours") == 12)
    before = table.filter(F.col("model") == "gbt_base").filter(F.col("slice_value") != "Hot (>= 20C)")
    after = table.filter(F.col("model") == "gbt_tuned").filter(F.col("slice_value") != "Clear (< 25%)")
    return before, after


COMPARED_SQL = f"""{SLICE_ROWS_SQL},
before AS (SELECT slice_type, slice_value, mae AS mae_before, r2 AS r2_before FROM slices WHERE horizon_hours = 12 AND model = 'gbt_base' AND slice_value <> 'Hot (>= 20C)'),
after AS (SELECT slice_type, slice_value, mae AS mae_after, r2 AS r2_after FROM slices WHERE horizon_hours = 12 AND model = 'gbt_tuned' AND slice_value <> 'Clear (< 25%)'),
compared AS (SELECT *, mae_before - mae_after AS mae_improvement, round_even((mae_before - mae_after) / nullif(mae_before, 0) * 100, 2) AS mae_improvement_pct
  FROM before FULL JOIN after USING (slice_type, slice_value))"""
COMPARED_FLOATS = "mae_before r2_before mae_after r2_after mae_improvement mae_improvement_pct"


@query("j6_before_after", f"WITH {COMPARED_SQL} SELECT * FROM compared", floats=COMPARED_FLOATS, ctes="scores")
def _(t: Tables) -> DataFrame:
    return decisions.compare_slices(*two_models(t))


@query("m13_mitigation_comparison", f"WITH {COMPARED_SQL} SELECT *, 'gbt' AS model, 12 AS horizon FROM compared", floats=COMPARED_FLOATS, ctes="scores")
def _(t: Tables) -> DataFrame:
    return decisions.compare_slices(*two_models(t)).withColumns({"model": F.lit("gbt"), "horizon": F.lit(12)})


@query(
    "a23_mean_improvement",
    f"WITH {COMPARED_SQL} SELECT round_even(avg(mae_improvement_pct), 4) AS avg_improvement_pct FROM compared WHERE slice_type IN ('zone', 'carbon_bucket')",
    floats="avg_improvement_pct",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return decisions.mean_improvement(decisions.compare_slices(*two_models(t)))


@query(
    "a27_findings",
    f"""WITH {COMPARED_SQL}, {DISPARITY_SQL},
z AS (SELECT slice_value, pct_deviation FROM disparity WHERE flagged AND slice_type = 'zone' ORDER BY abs(relative_diff) DESC, slice_value DESC, pct_deviation DESC LIMIT 1),
b AS (SELECT slice_value, pct_deviation FROM disparity WHERE flagged AND slice_type = 'carbon_bucket' ORDER BY relative_diff DESC, slice_value DESC, pct_deviation DESC LIMIT 1)
SELECT (SELECT slice_value FROM z) AS worst_zone, (SELECT pct_deviation FROM z) AS worst_zone_deviation, (SELECT slice_value FROM b) AS worst_bucket, (SELECT pct_deviation FROM b) AS worst_bucket_deviation,
  (SELECT count(*) FROM disparity WHERE flagged AND slice_type = 'weather_condition') AS flagged_weather,
  (SELECT avg(mae_improvement_pct) FROM compared WHERE slice_value = '5-LOW') AS mean_improvement_pct""",
    floats="mean_improvement_pct",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return metrics.findings(metrics.disparities(slices(t), PAIR), decisions.compare_slices(*two_models(t)), "5-LOW")


@query(
    "f16_metric_log",
    f"""WITH {COMPARED_SQL}, k AS (SELECT *, slice_type || '__' || replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  slice_value, ' ', '_'), '/', '_'), '(', ''), ')', ''), '+', 'plus'), '%', 'pct'), '<', 'lt'), '>', 'gt'), '=', 'eq'), '-', ''), '.', '') AS key FROM compared)
SELECT key || '__mae_before' AS metric, mae_before AS value FROM k UNION ALL SELECT key || '__mae_after', mae_after FROM k UNION ALL SELECT key || '__improvement_pct', mae_improvement_pct FROM k""",
    floats="value",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return decisions.metric_log(decisions.compare_slices(*two_models(t)))


@query(
    "a28_residual_stats",
    """SELECT model, horizon_hours, avg(r) AS mean_residual, stddev_pop(r) AS std_residual, avg(abs(r)) AS mae, min(r) AS min_residual, max(r) AS max_residual
FROM (SELECT *, actual - predicted AS r FROM scores) GROUP BY 1, 2""",
    floats="mean_residual std_residual mae",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return metrics.residual_stats(t.scores, PAIR)


@query(
    "a28_residual_histogram",
    """WITH r AS (SELECT model, actual - predicted AS r FROM scores), e AS (SELECT model, min(r) AS lo, (max(r) - min(r)) / 60 AS w FROM r GROUP BY model),
c AS (SELECT model, CAST(least(floor((r - lo) / w), 59) AS INTEGER) AS bin, count(*) AS n FROM r JOIN e USING (model) GROUP BY 1, 2),
f AS (SELECT model, lo, w, unnest(generate_series(0, 59))::INTEGER AS bin FROM e)
SELECT model, bin, lo + bin * w AS bin_start, coalesce(n, 0) AS count FROM f LEFT JOIN c USING (model, bin)""",
    floats="bin_start",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return metrics.residual_histogram(t.scores, ["model"])


@query(
    "a29_curve_scores",
    """SELECT horizon_hours, avg(abs(predicted - actual)) AS mae, 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2 FROM scores GROUP BY 1""",
    floats="mae r2",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return metrics.forecast_curve_scores(t.scores)


# --- quality ---------------------------------------------------------------------------


def first_half(t: Tables, later: bool) -> DataFrame:
    border = F.lit("2024-01-16").cast("timestamp")
    return t.readings.filter(F.col("datetime") >= border if later else F.col("datetime") < border)


HALVES = """base AS (SELECT * FROM readings WHERE datetime < TIMESTAMP '2024-01-16'), cur AS (SELECT * FROM readings WHERE datetime >= TIMESTAMP '2024-01-16')"""


@query(
    "q1_schema_anomalies",
    """SELECT 'readings' AS dataset, 'region' AS "column", 'missing column' AS anomaly, 'string' AS detail, NULL::BIGINT AS rows
UNION ALL SELECT 'readings', 'value', 'type changed', 'string -> double', NULL
UNION ALL SELECT 'readings', 'event_type', 'unexpected value', event_type, count(*) FROM events WHERE event_type NOT IN (SELECT DISTINCT event_type FROM events WHERE event_type < 'p') GROUP BY event_type""",
)
def _(t: Tables) -> DataFrame:
    stored = t["events"].filter(F.col("event_type") < "p").select("event_type")
    baseline = quality.infer_baseline(stored, name="readings")
    columns = {"event_type": "string", "region": "string", "value": "string", "user_id": "bigint"}
    return quality.schema_anomalies(t["events"].select("event_type", "value", "user_id"), baseline, columns, "readings")


@query(
    "q2_infer_baseline",
    """SELECT 'orders' AS dataset, c AS "column", ty AS type, NULL::VARCHAR AS value
FROM (VALUES ('o_orderkey', 'bigint'), ('o_orderstatus', 'string'), ('o_orderpriority', 'string')) v(c, ty)
UNION ALL SELECT DISTINCT 'orders', 'o_orderstatus', 'string', o_orderstatus FROM orders
UNION ALL SELECT DISTINCT 'orders', 'o_orderpriority', 'string', o_orderpriority FROM orders
UNION ALL SELECT 'documents', c, 'string', NULL FROM (VALUES ('key'), ('text')) v(c)
UNION ALL SELECT 'documents', 'key', 'string', CAST(l_orderkey AS VARCHAR) FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
)
def _(t: Tables) -> DataFrame:
    """A closed domain of over a thousand values, and a column declared open."""
    orders = quality.infer_baseline(t["orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority"), name="orders")
    keys = t["lineitem"].select(F.col("l_orderkey").cast("string").alias("key"), F.lit("free").alias("text"))
    return orders.unionByName(quality.infer_baseline(keys, open_columns=["text"], name="documents"))


@query(
    "q5_checks",
    f"""SELECT 'intensity in range' AS "check", count(*) FILTER (NOT coalesce({CI} BETWEEN 0 AND 1500, false)) = 0 AS passed, CAST(count(*) FILTER (NOT coalesce({CI} BETWEEN 0 AND 1500, false)) AS VARCHAR) AS detail FROM axis
UNION ALL SELECT 'no nulls', count(*) = count({CI}), CAST(count(*) - count({CI}) AS VARCHAR) FROM axis
UNION ALL SELECT 'rows', count(*) > 100 AND count(*) < 100000, CAST(count(*) AS VARCHAR) FROM axis
UNION ALL SELECT 'zones', count(DISTINCT zone) = 5, CAST(count(DISTINCT zone) AS VARCHAR) FROM axis
UNION ALL SELECT 'starts in january', min(datetime) < TIMESTAMP '2024-01-02', strftime(min(datetime), '%Y-%m-%d %H:%M:%S') FROM axis""",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    first = F.min("datetime")
    return quality.run_checks(
        t.grid_axis,
        {
            "intensity in range": quality.all_between(CI, 0, 1500),
            "no nulls": quality.no_nulls([CI]),
            "rows": quality.rows_between(100, 100_000),
            "zones": quality.distinct_count_is("zone", 5),
            "starts in january": (first < F.lit("2024-01-02").cast("timestamp"), first),
        },
    )


@query("q5_equal_rows", "SELECT min(n) = max(n) AS passed, min(n) AS fewest, max(n) AS most FROM (SELECT zone, count(*) AS n FROM observed GROUP BY zone)", ctes="observed")
def _(t: Tables) -> DataFrame:
    return quality.equal_rows_per_key(t.grid_observed)


def _drift_sql() -> str:
    def one(source: str, side: str) -> str:
        return f"""SELECT avg(user_id) AS {side}_mean, stddev_samp(user_id) AS {side}_std, quantile_cont(user_id, 0.25) AS {side}_p25, median(user_id) AS {side}_median,
  quantile_cont(user_id, 0.75) AS {side}_p75, 0.0::DOUBLE AS {side}_null_rate FROM {source}"""

    changes = ", ".join(f"current_{m} - baseline_{m} AS {m}_change" for m in ("mean", "std", "p25", "median", "p75", "null_rate"))
    return f"""WITH {HALVES}, b AS ({one('base', 'baseline')}), c AS ({one('cur', 'current')}) SELECT 'user_id' AS "column", b.*, c.*, {changes} FROM b, c"""


DRIFT_FLOATS = " ".join(f"{s}_{m}" for s in ("baseline", "current") for m in ("mean", "std", "p25", "median", "p75", "null_rate")) + " mean_change std_change p25_change median_change p75_change null_rate_change"


@query("q6_drift", _drift_sql(), floats=DRIFT_FLOATS, digits=5, ctes="readings")
def _(t: Tables) -> DataFrame:
    return quality.drift_table(first_half(t, True), first_half(t, False), ["user_id"])


@query(
    "q6_distribution_distance",
    f"""WITH {HALVES},
l AS (SELECT 'whole' AS feature, whole::DOUBLE AS v, 1 AS b, 0 AS c FROM base UNION ALL SELECT 'user_id', user_id::DOUBLE, 1, 0 FROM base
  UNION ALL SELECT 'whole', whole::DOUBLE, 0, 1 FROM cur UNION ALL SELECT 'user_id', user_id::DOUBLE, 0, 1 FROM cur),
n AS (SELECT feature, v, sum(b) AS b, sum(c) AS c FROM l WHERE v IS NOT NULL GROUP BY 1, 2),
f AS (SELECT feature, sum(b) OVER w / sum(b) OVER a AS fb, sum(c) OVER w / sum(c) OVER a AS fc, lead(v) OVER w - v AS step, sum(b) OVER a AS nb, sum(c) OVER a AS nc
  FROM n WINDOW w AS (PARTITION BY feature ORDER BY v), a AS (PARTITION BY feature))
SELECT feature, CAST(max(nb) AS BIGINT) AS baseline_n, CAST(max(nc) AS BIGINT) AS current_n, max(abs(fb - fc)) AS ks, sum(abs(fb - fc) * coalesce(step, 0)) AS wasserstein FROM f GROUP BY feature""",
    floats="ks wasserstein",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return distance.distribution_distance(first_half(t, True), first_half(t, False), ["whole", "user_id"])


@query(
    "q7_population_stability",
    f"""WITH {HALVES},
longb AS (SELECT 'whole' AS feature, whole::DOUBLE AS v FROM base UNION ALL SELECT 'user_id', user_id::DOUBLE FROM base),
longc AS (SELECT 'whole' AS feature, whole::DOUBLE AS v FROM cur UNION ALL SELECT 'user_id', user_id::DOUBLE FROM cur),
edges AS (SELECT feature, list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM longb GROUP BY feature),
pb AS (SELECT feature, len(list_filter(e, lambda x: x < v)) AS bin, count(*) AS n FROM longb JOIN edges USING (feature) GROUP BY 1, 2),
pc AS (SELECT feature, len(list_filter(e, lambda x: x < v)) AS bin, count(*) AS n FROM longc JOIN edges USING (feature) GROUP BY 1, 2),
sb AS (SELECT feature, bin, n / sum(n) OVER (PARTITION BY feature) AS p FROM pb), sc AS (SELECT feature, bin, n / sum(n) OVER (PARTITION BY feature) AS q FROM pc),
m AS (SELECT feature, greatest(coalesce(p, 0), 1e-6) AS p, greatest(coalesce(q, 0), 1e-6) AS q FROM sb FULL JOIN sc USING (feature, bin)),
r AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM m GROUP BY feature)
SELECT feature, psi, CASE WHEN psi > 0.2 THEN 'Warning' WHEN psi > 0.1 THEN 'Watch' ELSE 'OK' END AS status, CASE WHEN psi > 0.2 THEN 'Retrain recommended' ELSE '-' END AS action FROM r""",
    floats="psi",
    digits=5,
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return quality.population_stability(first_half(t, True), first_half(t, False), ["whole", "user_id"])


@query(
    "q8_oversample_counts",
    f"""WITH c AS (SELECT {LEVEL_SQL.format(c=CI)} AS carbon_bucket, count(*) AS n FROM observed GROUP BY 1)
SELECT carbon_bucket, max(n) OVER () AS rows FROM c""",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    labelled = t.grid_observed.withColumn("carbon_bucket", buckets.level(F.col(CI)))
    return resample.class_counts(resample.oversample(labelled, "carbon_bucket", ["zone", "datetime"]), "carbon_bucket")


@query("q8_oversampled_rows", f"SELECT *, {LEVEL_SQL.format(c=CI)} AS carbon_bucket FROM observed", ctes="observed")
def _(t: Tables) -> DataFrame:
    """The distinct rows of the balanced table are the original ones, unchanged."""
    labelled = t.grid_observed.withColumn("carbon_bucket", buckets.level(F.col(CI)))
    key = ["zone", "datetime"]
    return resample.shuffled(resample.oversample(labelled, "carbon_bucket", key), key).distinct()


@query(
    "q9_noisy_oversample",
    f"""SELECT zone, datetime, {', '.join(GRID_VALUES)}, 0::BIGINT AS synthetic_rows FROM observed
UNION ALL SELECT NULL, NULL, {', '.join('NULL' for _ in GRID_VALUES)}, greatest(4000 - count(*), 0) FROM observed WHERE {LEVEL_SQL.format(c=CI)} = 'Very Low'""",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    """All original rows unchanged, and the number of synthetic ones."""
    labelled = t.grid_observed.withColumn("carbon_bucket", buckets.level_with_range(F.col(CI)))
    made = resample.oversample_with_noise(
        labelled, "carbon_bucket", "Very Low (0-100)", 4000, ["zone", "datetime"], [c for c in GRID_VALUES if c != CI]
    )
    columns = ["zone", "datetime", *GRID_VALUES]
    original = made.filter(~F.col("is_synthetic")).select(*columns, F.lit(0).cast("long").alias("synthetic_rows"))
    types = {f.name: f.dataType for f in original.schema.fields}
    count = made.agg(F.count_if("is_synthetic").alias("synthetic_rows")).select(*[F.lit(None).cast(types[c]).alias(c) for c in columns], "synthetic_rows")
    return original.unionByName(count)


@query(
    "q12_schema_gate",
    """SELECT 'grid' AS dataset, 'PASSED' AS status, NULL::VARCHAR AS detail, 0::BIGINT AS anomalies
UNION ALL SELECT 'weather', CASE WHEN count(DISTINCT zone) > 1 THEN 'FAILED' ELSE 'PASSED' END, NULL, count(DISTINCT zone) FILTER (zone <> 'click') FROM weather
UNION ALL SELECT 'merged', 'SKIPPED', 'dataset missing', 0 UNION ALL SELECT 'features', 'SKIPPED', 'no baseline', 0""",
    ctes="weather",
)
def _(t: Tables) -> DataFrame:
    return quality.schema_gate(
        {"grid": t.grid_observed, "weather": t.weather, "merged": None, "features": t.grid_observed},
        {
            "grid": quality.infer_baseline(t.grid_observed),
            "weather": quality.infer_baseline(t.weather.filter(F.col("zone") == "click")),
        },
    )


@query(
    "q13_issue_totals",
    f"""WITH {SLICED_SQL} SELECT CAST(sum(CAST(is_underrepresented AS INTEGER) + CAST(is_overrepresented AS INTEGER)) AS BIGINT) AS issues FROM ({DISTRIBUTION_SQL})""",
    ctes="daily",
)
def _(t: Tables) -> DataFrame:
    return profile.issue_total(profile.slice_distribution(sliced(t), profile.SLICES))


# --- models and decisions -----------------------------------------------------------------

TARGETS = {1: "carbon_intensity_target_1h", 12: "carbon_intensity_target_12h", 24: "carbon_intensity_target_24h"}
LAG_24 = f"{CI}_lag_24h"


def labelled_grid(t: Tables) -> DataFrame:
    """The filled grid with targets and the value a day back, in one window pass."""
    return bounded_window(
        t.grid.select("zone", "datetime", CI),
        HOURLY,
        24,
        24,
        lambda w: {**features.lead_columns(w, CI, list(TARGETS)), LAG_24: F.lag(CI, 24).over(w)},
    )


BASELINE_SQL = f"""WITH lab AS (SELECT zone, datetime, {CI}, lag({CI}, 24) OVER w AS lag24, """ + ", ".join(
    f"lead({CI}, {h}) OVER w AS t{h}" for h in TARGETS
) + f""" FROM grid WINDOW w AS (PARTITION BY zone ORDER BY datetime)),
means AS (SELECT zone, hour(datetime) AS h, avg({CI}) AS m FROM lab WHERE datetime <= TIMESTAMP '2024-01-20' GROUP BY 1, 2),
test AS (SELECT lab.*, m FROM lab LEFT JOIN means ON lab.zone = means.zone AND hour(lab.datetime) = means.h WHERE datetime > TIMESTAMP '2024-01-20'),
long AS ({" UNION ALL ".join(f"SELECT '{name}' AS baseline_type, {h} AS horizon, t{h} AS actual, {c} AS predicted FROM test" for name, c in (("naive_persistence", CI), ("lag24h_persistence", "lag24"), ("historical_mean", "m")) for h in TARGETS)})
{scores_sql("baseline_type, horizon", "(SELECT * FROM long WHERE actual IS NOT NULL AND predicted IS NOT NULL)")}"""


def baselines(t: Tables) -> DataFrame:
    table = labelled_grid(t)
    border = F.lit("2024-01-20").cast("timestamp")
    return split.horizon_baselines(
        table.filter(F.col("datetime") <= border), table.filter(F.col("datetime") > border), TARGETS
    )


@query("m1_naive_persistence", f"SELECT * FROM ({BASELINE_SQL}) WHERE baseline_type = 'naive_persistence'", floats="mae rmse r2 mape", ctes="grid")
def _(t: Tables) -> DataFrame:
    return baselines(t).filter(F.col("baseline_type") == "naive_persistence")


@query("m2_day_ago_persistence", f"SELECT * FROM ({BASELINE_SQL}) WHERE baseline_type = 'lag24h_persistence'", floats="mae rmse r2 mape", ctes="grid")
def _(t: Tables) -> DataFrame:
    return baselines(t).filter(F.col("baseline_type") == "lag24h_persistence")


@query("m3_zone_hour_baseline", f"SELECT * FROM ({BASELINE_SQL}) WHERE baseline_type = 'historical_mean'", floats="mae rmse r2 mape", ctes="grid")
def _(t: Tables) -> DataFrame:
    return baselines(t).filter(F.col("baseline_type") == "historical_mean")


@query(
    "m4_series_baselines",
    f"""WITH p AS (SELECT {CI} AS y, lag({CI}) OVER w AS p1, lag({CI}, 24) OVER w AS p24, avg({CI}) OVER (PARTITION BY hour(datetime)) AS pm FROM grid WINDOW w AS (PARTITION BY zone ORDER BY datetime)),
l AS (SELECT 'persistence_1h' AS baseline, y, p1 AS p FROM p UNION ALL SELECT 'persistence_24h', y, p24 FROM p UNION ALL SELECT 'historical_mean', y, pm FROM p)
SELECT baseline, round_even(avg(abs(y - p)), 2) AS mae, round_even(sqrt(avg((y - p) * (y - p))), 2) AS rmse, round_even(avg(abs((y - p) / nullif(y, 0))) * 100, 2) AS mape FROM l WHERE p IS NOT NULL GROUP BY baseline""",
    floats="mae rmse mape",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return split.series_baseline_report(t.grid.select("zone", "datetime", CI))


MODEL_SCORES_SQL = scores_sql("model, horizon_hours")


def model_scores(t: Tables) -> DataFrame:
    return metrics.scores(t.scores, PAIR).select(F.col("horizon_hours").alias("horizon"), F.col("model").alias("model_type"), "mae", "rmse", "r2", "mape")


def zone_baselines(t: Tables) -> DataFrame:
    """Each zone's score stands in for a baseline."""
    return metrics.scores(t.scores, ["zone", "horizon_hours"]).select(
        F.col("horizon_hours").alias("horizon"), F.col("zone").alias("baseline_type"), "mae", "rmse", "r2", "mape"
    )


COMPARISON_SQL = f"""ms AS ({MODEL_SCORES_SQL}), bs AS ({scores_sql("zone, horizon_hours")}),
cmp AS (SELECT horizon_hours AS horizon, 'Best Baseline (' || horizon_hours || 'h)' AS model, 'baseline' AS model_type, mae, rmse, r2, mape FROM bs
  QUALIFY row_number() OVER (PARTITION BY horizon_hours ORDER BY mae, zone) = 1
UNION ALL SELECT horizon_hours, model || ' (' || horizon_hours || 'h)', model, mae, rmse, r2, mape FROM ms)"""


@query("m12_comparison_table", f"WITH {COMPARISON_SQL} SELECT * FROM cmp", floats="mae rmse r2 mape", ctes="scores")
def _(t: Tables) -> DataFrame:
    return metrics.comparison_table(zone_baselines(t), model_scores(t))


@query(
    "m12_best_models",
    f"WITH {COMPARISON_SQL} SELECT * FROM cmp WHERE model_type <> 'baseline' QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mae, model) = 1",
    floats="mae rmse r2 mape",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return metrics.select_best_models(metrics.comparison_table(zone_baselines(t), model_scores(t)))


VERDICT_SQL = f"""ms AS ({MODEL_SCORES_SQL}),
n AS (SELECT horizon_hours AS horizon, mae AS mae_new, rmse AS rmse_new, r2 AS r2_new FROM ms WHERE model = 'gbt_tuned'),
c AS (SELECT horizon_hours AS horizon, mae AS mae_current, rmse AS rmse_current, r2 AS r2_current FROM ms WHERE model = 'gbt_base' AND horizon_hours <> 24),
v AS (SELECT horizon, CASE WHEN mae_current IS NULL THEN 'improved' WHEN (mae_new - mae_current) / mae_current <= -0.005 AND NOT r2_new - r2_current < -0.02 THEN 'improved'
    WHEN (mae_new - mae_current) / mae_current <= 0.01 AND NOT r2_new - r2_current < -0.02 THEN 'neutral' ELSE 'regressed' END AS verdict,
  mae_current, mae_new, round_even(mae_new - mae_current, 4) AS mae_delta, round_even((mae_new - mae_current) / mae_current * 100, 3) AS mae_pct,
  round_even(rmse_new - rmse_current, 4) AS rmse_delta, round_even(r2_new - r2_current, 4) AS r2_delta, coalesce(r2_new - r2_current < -0.02, false) AS r2_violated
  FROM n LEFT JOIN c USING (horizon))"""


def verdicts(t: Tables) -> DataFrame:
    table = model_scores(t)
    current = table.filter((F.col("model_type") == "gbt_base") & (F.col("horizon") != 24))
    return decisions.promotion_verdicts(table.filter(F.col("model_type") == "gbt_tuned"), current)


@query("j7_new_against_current", f"WITH {VERDICT_SQL} SELECT * FROM v", floats="mae_current mae_new mae_delta mae_pct rmse_delta r2_delta", ctes="scores")
def _(t: Tables) -> DataFrame:
    return verdicts(t)


@query(
    "m14_promotion_decision",
    f"""WITH {VERDICT_SQL} SELECT count(*) FILTER (verdict = 'improved') AS improved, count(*) FILTER (verdict = 'neutral') AS neutral, count(*) FILTER (verdict = 'regressed') AS regressed,
  CASE WHEN count(*) FILTER (verdict = 'regressed') = 0 THEN 'promote' ELSE 'reject' END AS decision FROM v""",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return decisions.promotion_decision(verdicts(t))


CHANGE_SQL = f"""ms AS ({MODEL_SCORES_SQL}), bs AS (SELECT horizon_hours, min(mae) AS b FROM ({scores_sql("zone, horizon_hours")}) GROUP BY 1),
ch AS (SELECT m.horizon_hours AS horizon, m.mae, b AS baseline_mae, (m.mae - b) / b AS pct_change FROM ms m JOIN bs USING (horizon_hours) WHERE model = 'gbt_tuned' AND b > 0)"""


def changes(t: Tables) -> DataFrame:
    base = zone_baselines(t).groupBy("horizon").agg(F.min("mae").alias("mae"))
    return decisions.mae_change(model_scores(t).filter(F.col("model_type") == "gbt_tuned"), base)


@query("j8_mae_change", f"WITH {CHANGE_SQL} SELECT * FROM ch", floats="mae baseline_mae pct_change", digits=4, ctes="scores")
def _(t: Tables) -> DataFrame:
    return changes(t)


@query(
    "m15_metric_alerts",
    f"""WITH {CHANGE_SQL}, half AS (SELECT CASE WHEN datetime < TIMESTAMP '1999-01-01' THEN 0 ELSE 1 END AS h, actual FROM scores),
moments AS (SELECT avg(actual) FILTER (h = 0) AS m0, avg(actual) FILTER (h = 1) AS m1, stddev_samp(actual) FILTER (h = 0) AS s0 FROM half),
drift AS (SELECT CASE WHEN abs(m1 - m0) > 0.01 * s0 THEN 1.0 ELSE 0.0 END AS d FROM moments),
crit AS (SELECT CAST(count(*) FILTER (abs(round_even((predicted - actual) / 64 * 100, 1)) > 80) AS DOUBLE) AS c FROM scores),
m AS (SELECT 'mae' AS metric, CAST(horizon_hours AS VARCHAR) AS label, mae AS value FROM ms WHERE model = 'gbt_tuned'
  UNION ALL SELECT 'mae_pct_change', CAST(horizon AS VARCHAR), pct_change FROM ch UNION ALL SELECT 'drift_detected', 'all', d FROM drift UNION ALL SELECT 'bias_critical_count', 'all', c FROM crit)
SELECT metric, label, value, 'ModelDecayWarning' AS rule, 'warning' AS severity FROM m WHERE metric = 'mae_pct_change' AND value > 0.20
UNION ALL SELECT metric, label, value, 'ModelDecayCritical', 'critical' FROM m WHERE metric = 'mae_pct_change' AND value > 0.35
UNION ALL SELECT metric, label, value, 'DataDriftDetected', 'critical' FROM m WHERE metric = 'drift_detected' AND value = 1
UNION ALL SELECT metric, label, value, 'BiasCheckFailed', 'warning' FROM m WHERE metric = 'bias_critical_count' AND value > 0""",
    floats="value",
    digits=4,
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    """Drift comes from the profiles of two halves, the critical count from the deviations."""
    later = F.col("datetime") >= F.lit("1999-01-01").cast("timestamp")
    drift = quality.drift_flag(quality.drift_table(t.scores.filter(later), t.scores.filter(~later), ["actual"]), 0.01)
    deviation = signed_percent((F.col("predicted") - F.col("actual")) / 64)
    critical = metrics.critical_count(t.scores.select(deviation.alias("pct_deviation")))
    tuned = model_scores(t).filter(F.col("model_type") == "gbt_tuned")
    table = decisions.metric_table(F.current_timestamp(), tuned, changes(t), drift, critical)
    return decisions.evaluate_rules(table)


@query(
    "f13_improvement_report",
    f"""WITH {CHANGE_SQL} SELECT horizon, mae, baseline_mae, round_even((baseline_mae - mae) / baseline_mae * 100, 2) AS mae_improvement_pct,
  CASE WHEN (baseline_mae - mae) / baseline_mae >= 0.60 THEN 'excellent' WHEN (baseline_mae - mae) / baseline_mae >= 0.45 THEN 'good' WHEN (baseline_mae - mae) / baseline_mae >= 0.25 THEN 'fair' ELSE 'poor' END AS tier FROM ch""",
    floats="mae baseline_mae mae_improvement_pct",
    digits=4,
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    base = zone_baselines(t).groupBy("horizon").agg(F.min("mae").alias("mae"))
    return decisions.improvement_report(model_scores(t).filter(F.col("model_type") == "gbt_tuned"), base)


AUDIT_SQL = """audit AS (SELECT o_orderpriority AS model_type, o_orderkey AS entry, o_orderdate AS logged_at,
  CASE WHEN o_orderstatus = 'O' THEN 'rollback' ELSE 'promote' END AS event, CASE WHEN o_totalprice > 100000 THEN 'success' ELSE 'failed' END AS status, CAST(o_custkey AS VARCHAR) AS version FROM orders)"""


def audit(t: Tables) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderpriority").alias("model_type"),
        F.col("o_orderkey").alias("entry"),
        F.col("o_orderdate").alias("logged_at"),
        F.when(F.col("o_orderstatus") == "O", "rollback").otherwise("promote").alias("event"),
        F.when(F.col("o_totalprice") > 100_000, "success").otherwise("failed").alias("status"),
        F.col("o_custkey").cast("string").alias("version"),
    )


@query(
    "w16_rollback_target",
    f"""WITH {AUDIT_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY logged_at DESC, entry DESC) AS r FROM audit WHERE status = 'success')
SELECT model_type, max(version) FILTER (r = 2) AS target_version, max(version) FILTER (r = 1) AS current_version, 'audit_log' AS source FROM d WHERE r <= 2 GROUP BY model_type""",
)
def _(t: Tables) -> DataFrame:
    return decisions.rollback_target(audit(t))


@query(
    "w16_rollback_from_versions",
    """WITH v AS (SELECT o_orderpriority AS model_type, CAST(o_orderkey AS VARCHAR) AS version, o_orderdate AS created_at, o_orderstatus = 'F' AS p FROM orders),
c AS (SELECT model_type, arg_max(version, (created_at, version)) AS current_version FROM v WHERE p GROUP BY 1)
SELECT v.model_type, current_version, arg_max(version, (created_at, version)) AS target_version, 'version_history' AS source FROM v JOIN c USING (model_type) WHERE version <> current_version GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    versions = t["orders"].select(
        F.col("o_orderpriority").alias("model_type"),
        F.col("o_orderkey").cast("string").alias("version"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") == "F").alias("is_production"),
    )
    none = audit(t).withColumn("version", F.lit(""))
    return decisions.rollback_target(none, versions)


@query(
    "w17_best_run",
    """SELECT o_custkey % 4 AS horizon, o_orderkey AS run_id, o_orderpriority AS model_type, o_totalprice AS test_mae FROM orders WHERE o_orderpriority = '1-URGENT'
QUALIFY row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY o_totalprice, o_orderkey) = 1""",
    floats="test_mae",
)
def _(t: Tables) -> DataFrame:
    runs = t["orders"].select(
        (F.col("o_custkey") % 4).alias("horizon"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("model_type"),
        F.col("o_totalprice").alias("test_mae"),
    )
    return decisions.best_run(runs, model_type="1-URGENT")


@query("w19_newest_history", f"WITH {AUDIT_SQL} SELECT * FROM audit WHERE model_type = '5-LOW' ORDER BY logged_at DESC, entry DESC LIMIT 20")
def _(t: Tables) -> DataFrame:
    return decisions.newest_entries(audit(t).filter(F.col("model_type") == "5-LOW"), 20, ["logged_at", "entry"])


@query(
    "j11_align_predictions",
    f"""SELECT p.zone, p.datetime, 12 AS horizon_hours, p.{LOAD} AS predicted, a.{CI} AS actual FROM observed p LEFT JOIN observed a ON a.zone = p.zone AND a.datetime = p.datetime + INTERVAL 12 HOUR""",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    made = t.grid_observed.select("zone", "datetime", F.lit(12).alias("horizon_hours"), F.col(LOAD).alias("predicted"))
    return metrics.align_predictions(made, t.grid_observed.select("zone", "datetime", F.col(CI).alias("actual")))


# --- schedules -------------------------------------------------------------------------------

PLAN_SQL = """placed AS (SELECT *, row_number() OVER (PARTITION BY zone, run ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY zone, run) AS len FROM forecasts),
means AS (SELECT a.zone, a.run, r AS runtime_hours, a.pos, a.datetime, a.len, avg(b.predicted_carbon_intensity) AS m FROM placed a, generate_series(1, 6) g(r), placed b
  WHERE b.zone = a.zone AND b.run = a.run AND b.pos >= a.pos AND b.pos < a.pos + r AND a.pos + r <= a.len GROUP BY ALL),
best AS (SELECT j.job_id, arg_min({'pos': pos, 'dt': datetime, 'm': m}, (m, pos)) AS b, max(m) FILTER (pos = 0) AS now_m FROM jobs j JOIN means f ON f.zone = j.zone AND f.run = j.run AND f.runtime_hours = j.runtime_hours
  AND f.pos <= j.flexibility_hours GROUP BY j.job_id),
plan AS (SELECT j.*, b.pos AS hours_to_wait, b.dt AS recommended_start, round_even(b.m, 2) AS expected_intensity, round_even(now_m, 2) AS immediate_intensity,
  round_even(now_m * energy_kwh / 1000, 3) AS immediate_co2_kg, round_even(b.m * energy_kwh / 1000, 3) AS optimal_co2_kg,
  round_even(now_m * energy_kwh / 1000 - b.m * energy_kwh / 1000, 3) AS co2_saved_kg,
  round_even(CASE WHEN now_m > 0 THEN (now_m * energy_kwh / 1000 - b.m * energy_kwh / 1000) / (now_m * energy_kwh / 1000) * 100 WHEN now_m IS NOT NULL THEN 0 END, 1) AS co2_savings_pct
  FROM jobs j LEFT JOIN best USING (job_id))"""
PLAN_FLOATS = "expected_intensity immediate_intensity immediate_co2_kg optimal_co2_kg co2_saved_kg co2_savings_pct"


def planned(t: Tables) -> DataFrame:
    options = schedule.start_options(t.forecasts, RUNS, range(1, 7))
    return schedule.plan_jobs(t.jobs, options, ["zone", "run"])


@query("m17_job_plan", f"WITH {PLAN_SQL} SELECT * FROM plan", floats=PLAN_FLOATS, ctes="forecasts jobs")
def _(t: Tables) -> DataFrame:
    return planned(t).drop("recommendation")


@query(
    "j10_jobs_by_start",
    f"""WITH {PLAN_SQL} SELECT zone, runtime_hours, hours_to_wait, count(*) AS jobs FROM plan GROUP BY 1, 2, 3""",
    ctes="forecasts jobs",
)
def _(t: Tables) -> DataFrame:
    return planned(t).groupBy("zone", "runtime_hours", "hours_to_wait").agg(F.count(F.lit(1)).alias("jobs"))


def _one_digit(value: str) -> str:
    """One digit of the shortest decimal form, ties upwards."""
    return f"CAST(CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 20)) AS DECIMAL(28, 1)) AS VARCHAR)"


@query(
    "f14_recommendation",
    f"""WITH {PLAN_SQL}, raw AS (SELECT job_id, b.pos AS wait, b.dt AS start, now_m * energy_kwh / 1000 - b.m * energy_kwh / 1000 AS saved, now_m * energy_kwh / 1000 AS now_kg FROM jobs j LEFT JOIN best b USING (job_id))
SELECT job_id, CASE WHEN wait > 0 THEN 'Wait ' || wait || ' hours — start at ' || strftime(start, '%Y-%m-%d %H:%M:%S') || '. Save ' || {_one_digit('saved')}
  || ' kg CO₂ (' || {_one_digit('CASE WHEN now_kg > 0 THEN saved / now_kg * 100 ELSE 0 END')} || '% reduction).' WHEN wait = 0 THEN 'Run now — this is already the optimal window.' END AS advice FROM raw""",
    ctes="forecasts jobs",
)
def _(t: Tables) -> DataFrame:
    return planned(t).select("job_id", F.col("recommendation").alias("advice"))


@query(
    "a21_impact",
    f"""WITH {PLAN_SQL} SELECT zone, count(*) AS jobs, sum(co2_saved_kg) AS co2_saved_kg, avg(coalesce(hours_to_wait, 0)) AS average_delay_hours, sum(co2_saved_kg) / 13.3 AS tree_equivalents FROM plan GROUP BY zone""",
    floats="co2_saved_kg average_delay_hours tree_equivalents",
    ctes="forecasts jobs",
)
def _(t: Tables) -> DataFrame:
    return schedule.impact(planned(t), ["zone"])


@query(
    "x7_alert_intervals",
    """WITH s AS (SELECT zone AS label, datetime, carbon_intensity_gco2_per_kwh / 1000 AS value, row_number() OVER (PARTITION BY zone ORDER BY datetime) AS pos FROM observed),
j AS (SELECT rule, lim, hold, severity, s.*, value > lim AS bad FROM s, (VALUES ('ModelDecayWarning', 0.20, 300, 'warning'), ('ModelDecayCritical', 0.35, 120, 'critical')) r(rule, lim, hold, severity)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY rule, label ORDER BY datetime) AS grp FROM j WHERE bad)
SELECT rule, 'mae_pct_change' AS metric, label, severity, min(datetime) AS started_at, max(datetime) AS last_seen, max(value) AS worst_value FROM g
GROUP BY rule, label, severity, hold, grp HAVING epoch(max(datetime)) - epoch(min(datetime)) >= hold""",
    floats="worst_value",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    samples = t.grid_observed.select(
        F.lit("mae_pct_change").alias("metric"), F.col("zone").alias("label"), F.col("datetime").alias("ts"), (F.col(CI) / 1000).alias("value")
    )
    return decisions.alert_intervals(samples, step_seconds=3600)
