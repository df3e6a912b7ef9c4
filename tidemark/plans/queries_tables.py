"""Queries over projections, filters, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import buckets, calendar, parsing, scalars
from tidemark.operators import clean, decisions, features, schedule, split
from tidemark.operators.metrics import weather_classes, with_errors
from tidemark.operators.series import Series, latest_rows
from tidemark.plans.canonical import GRID_VALUES, HOURLY, RUNS, TRAIN_END, VAL_END, WEATHER_VALUES, ZONES, Tables
from tidemark.plans.registry import query

CI, CFE, REN, LOAD = GRID_VALUES[0], GRID_VALUES[1], GRID_VALUES[3], GRID_VALUES[4]

# A raw signal table: text times and text values, some of them unreadable.
RAW_SQL = """SELECT event_id, event_type AS zone,
  CASE WHEN k = 13 THEN 'not a time' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS datetime,
  CASE WHEN k < 5 THEN 'n/a' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS "carbonIntensity"
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def raw_signal(t: Tables) -> DataFrame:
    bad_time = F.when(F.col("k") == 13, "not a time").otherwise(parsing.format_iso_z(F.col("ts")))
    return t.readings.select(
        "event_id",
        "zone",
        bad_time.alias("datetime"),
        F.when(F.col("k") < 5, "n/a").otherwise(F.col("whole").cast("string")).alias("carbonIntensity"),
    )


@query(
    "p1_signal_projection",
    f"""SELECT zone, CAST(replace(replace(datetime, 'T', ' '), 'Z', '') AS TIMESTAMP) AS datetime,
  TRY_CAST("carbonIntensity" AS DOUBLE) AS "carbon-intensity" FROM ({RAW_SQL}) WHERE datetime <> 'not a time'""",
)
def _(t: Tables) -> DataFrame:
    raw = raw_signal(t).filter(F.col("datetime") != "not a time")
    return clean.project_signal(raw, "carbon-intensity", {"carbon-intensity": "carbonIntensity"})


@query(
    "p2_select_and_rename",
    "SELECT ts AS datetime, event_type AS zone, value AS temperature_2m_c FROM events",
)
def _(t: Tables) -> DataFrame:
    mapping = {"ts": "datetime", "event_type": "zone", "value": "temperature_2m_c", "rain": "rain_mm"}
    return clean.select_and_rename(t["events"], mapping, required=["ts"])


@query("p3_rename_present", "SELECT * RENAME (event_type AS zone, ts AS datetime) FROM events")
def _(t: Tables) -> DataFrame:
    return clean.rename_present(t["events"], {"event_type": "zone", "ts": "datetime", "snowfall": "snowfall_cm"})


@query(
    "p4_parse_utc",
    "SELECT event_id, date_trunc('second', ts) AS datetime FROM events",
)
def _(t: Tables) -> DataFrame:
    text = t.readings.select("event_id", parsing.format_iso_z(F.col("ts")).alias("text"))
    return text.select("event_id", parsing.parse_utc(F.col("text")).alias("datetime"))


@query(
    "p5_bad_datetimes",
    f"""SELECT zone, count(*) AS rows, count(*) FILTER (datetime = 'not a time') AS bad_datetimes FROM ({RAW_SQL}) GROUP BY zone""",
)
def _(t: Tables) -> DataFrame:
    parsed = parsing.try_parse_utc(F.col("datetime"))
    return raw_signal(t).groupBy("zone").agg(F.count(F.lit(1)).alias("rows"), F.count_if(parsed.isNull()).alias("bad_datetimes"))


@query("p6_to_number", f"""SELECT event_id, TRY_CAST("carbonIntensity" AS DOUBLE) AS value FROM ({RAW_SQL})""")
def _(t: Tables) -> DataFrame:
    return raw_signal(t).select("event_id", parsing.to_number(F.col("carbonIntensity")).alias("value"))


@query(
    "p7_iso_format_floor",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('hour', ts) AS hour_start FROM events""",
)
def _(t: Tables) -> DataFrame:
    return t["events"].select(
        "event_id", parsing.format_iso_z(F.col("ts")).alias("iso"), parsing.floor_to_hour(F.col("ts")).alias("hour_start")
    )


@query(
    "p8_training_window",
    """SELECT event_id, ts AS datetime FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 23:59:59'""",
)
def _(t: Tables) -> DataFrame:
    named = t["events"].select("event_id", F.col("ts").alias("datetime"))
    return clean.training_window(named, "2024-01-05", "2024-01-20")


RANGES = {CI: (50.0, 600.0), CFE: (2.0, 100.0), "absent_column": (0.0, 1.0)}


@query(
    "p9_clip",
    f"""SELECT zone, datetime, CASE WHEN {CI} IS NOT NULL THEN greatest(50.0, least(600.0, {CI})) END AS {CI},
  CASE WHEN {CFE} IS NOT NULL THEN greatest(2.0, least(100.0, {CFE})) END AS {CFE} FROM axis""",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    return clean.clip_columns(t.grid_axis.select("zone", "datetime", CI, CFE), RANGES)


@query(
    "p9_out_of_range",
    f"""SELECT '{CI}' AS "column", count(*) FILTER ({CI} < 50 OR {CI} > 600) AS outliers FROM axis
UNION ALL SELECT '{CFE}', count(*) FILTER ({CFE} < 2 OR {CFE} > 100) FROM axis""",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    return clean.count_out_of_range(t.grid_axis, RANGES)


@query(
    "p10_zone_mapping",
    """SELECT s.s_suppkey, n.n_name AS zone, coalesce(r.r_name, 'unknown') AS region
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN (SELECT * FROM region WHERE r_name LIKE 'A%') r ON n.n_regionkey = r.r_regionkey""",
)
def _(t: Tables) -> DataFrame:
    nations = t["nation"].withColumnRenamed("n_name", "zone")
    known = t["region"].filter(F.col("r_name").like("A%"))
    dimension = nations.join(known, F.col("n_regionkey") == F.col("r_regionkey")).select("zone", F.col("r_name").alias("region"))
    suppliers = t["supplier"].join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "zone")
    return clean.map_zone(suppliers, dimension, ["region"])


@query(
    "p11_one_hot",
    "SELECT event_id, " + ", ".join(f"CAST(event_type = '{z}' AS INTEGER) AS zone_{z}" for z in ZONES) + " FROM events",
)
def _(t: Tables) -> DataFrame:
    return features.one_hot(t.readings.select("event_id", "zone"), "zone", ZONES)


@query(
    "p12_feature_columns",
    f"""SELECT "column" FROM (VALUES {", ".join(f"('{c}')" for c in sorted([c for c in GRID_VALUES if c != CI] + [f"zone_{z}" for z in ZONES]))}) v("column")
WHERE (SELECT count(*) FROM events) > 0""",
)
def _(t: Tables) -> DataFrame:
    """Names of the model matrix of the observed grid, kept while the grid has rows."""
    chosen = features.FeatureColumns(categories={"zone": ZONES}).choose(t.grid_observed)
    some = t.grid_observed.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
    return some.select(F.explode(F.array(*[F.lit(c) for c in chosen])).alias("column"))


@query(
    "p13_align_columns",
    f"SELECT {LOAD}, {CI}, 0 AS missing_feature, 0 AS zone FROM observed",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return features.align_columns(t.grid_observed, [LOAD, CI, "missing_feature", "zone"])


@query(
    "p14_common_columns",
    f"SELECT zone, datetime, {CI}, {LOAD} FROM observed",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    shared = features.common_columns(t.grid_observed, t.daily_observed, t.grid_observed.drop("net_load_mw"))
    return t.grid_observed.select(*shared)


@query(
    "p15_drop_unlabelled",
    f"""SELECT * FROM (SELECT zone, datetime, {CI}, """
    + ", ".join(f"lead({CI}, {h}) OVER (PARTITION BY zone ORDER BY datetime) AS carbon_intensity_target_{h}h" for h in (1, 6, 12, 24))
    + """ FROM grid) WHERE carbon_intensity_target_24h IS NOT NULL AND carbon_intensity_target_12h IS NOT NULL
  AND carbon_intensity_target_6h IS NOT NULL AND carbon_intensity_target_1h IS NOT NULL""",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    return split.drop_unlabelled(features.add_targets(t.grid.select("zone", "datetime", CI), HOURLY))


@query(
    "p16_floor_predictions",
    "SELECT row_id, greatest(predicted, 0.0) AS predicted, round_even(greatest(predicted, 50.0), 1) AS served FROM scores",
    floats="served",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    p = F.col("predicted")
    return t.scores.select("row_id", scalars.floor_at(p, 0).alias("predicted"), scalars.half_even(scalars.floor_at(p, 50), 1).alias("served"))


SPLIT_CASE = f"""CASE WHEN datetime <= TIMESTAMP '{TRAIN_END}' THEN 'train'
  WHEN datetime <= TIMESTAMP '{VAL_END}' THEN 'val' ELSE 'test' END"""


@query("p17_temporal_split", f"SELECT zone, datetime, {CI}, {SPLIT_CASE} AS split FROM daily", ctes="daily")
def _(t: Tables) -> DataFrame:
    return split.assign_split(t.daily_observed.select("zone", "datetime", CI), TRAIN_END, VAL_END)


@query(
    "p17_split_with_embargo",
    f"""SELECT zone, datetime, {SPLIT_CASE} AS split FROM daily
WHERE NOT (datetime > TIMESTAMP '{TRAIN_END}' - INTERVAL 48 HOUR AND datetime <= TIMESTAMP '{TRAIN_END}')
  AND NOT (datetime > TIMESTAMP '{VAL_END}' - INTERVAL 48 HOUR AND datetime <= TIMESTAMP '{VAL_END}')""",
    ctes="daily",
)
def _(t: Tables) -> DataFrame:
    kept = split.embargo(t.daily_observed.select("zone", "datetime"), TRAIN_END, VAL_END, 48)
    return split.assign_split(kept, TRAIN_END, VAL_END)


WEATHER_SQL = """SELECT row_id, unnest(list_filter([
  CASE WHEN temperature_2m_c < 5 THEN 'Cold (< 5C)' END,
  CASE WHEN temperature_2m_c >= 5 AND temperature_2m_c < 20 THEN 'Mild (5-20C)' END,
  CASE WHEN temperature_2m_c >= 20 THEN 'Hot (>= 20C)' END,
  CASE WHEN wind_speed_100m_ms >= 10 THEN 'Windy (>= 10 m/s)' END,
  CASE WHEN wind_speed_100m_ms < 10 THEN 'Calm (< 10 m/s)' END,
  CASE WHEN cloud_cover_pct >= 75 THEN 'Overcast (>= 75%)' END,
  CASE WHEN cloud_cover_pct < 25 THEN 'Clear (< 25%)' END], lambda x: x IS NOT NULL)) AS weather FROM scores"""


@query("p18_weather_classes", WEATHER_SQL, ctes="scores")
def _(t: Tables) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in weather_classes().items()]))
    return t.scores.select("row_id", F.explode(named).alias("weather"))


LEVEL_SQL = """CASE WHEN {c} IS NULL OR {c} < 0 THEN 'Unknown' WHEN {c} < 100 THEN 'Very Low' WHEN {c} < 200 THEN 'Low'
  WHEN {c} < 350 THEN 'Medium' WHEN {c} < 500 THEN 'High' ELSE 'Very High' END"""


@query(
    "p19_known_levels",
    f"SELECT * FROM (SELECT zone, datetime, {LEVEL_SQL.format(c=CI)} AS carbon_bucket FROM axis) WHERE carbon_bucket <> 'Unknown'",
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    return t.grid_axis.select("zone", "datetime", buckets.level(F.col(CI)).alias("carbon_bucket")).filter(F.col("carbon_bucket") != "Unknown")


@query("p20_zone_whitelist", "SELECT * FROM observed WHERE zone IN ('click', 'view')", ctes="observed")
def _(t: Tables) -> DataFrame:
    return t.grid_observed.filter(F.col("zone").isin("click", "view"))


# --- sorts and set operations ------------------------------------------------------


@query(
    "t1_sorted_series",
    "SELECT * FROM observed",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    """Spread by (zone, datetime) ranges, sorted in each part: the layout stage tables are written in."""
    return t.grid_observed.repartitionByRange("zone", "datetime").sortWithinPartitions("zone", "datetime")


@query(
    "t2_top_features",
    """SELECT o_custkey AS feature, sum(CAST(floor(o_totalprice) AS BIGINT))::BIGINT AS importance FROM orders
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(t: Tables) -> DataFrame:
    ranked = t["orders"].groupBy(F.col("o_custkey").alias("feature")).agg(F.sum(F.floor("o_totalprice")).alias("importance"))
    return ranked.orderBy(F.desc("importance"), "feature").limit(10)


@query(
    "t3_latest_runs",
    """SELECT o_orderkey AS run_id, o_orderdate AS start_time FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500""",
)
def _(t: Tables) -> DataFrame:
    finished = t["orders"].filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("start_time")
    )
    return decisions.newest_entries(finished, 500, ["start_time", "run_id"])


@query(
    "t4_newest_version",
    """SELECT o_orderpriority AS model_type, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version, max(o_orderdate) AS created_at
FROM orders GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    versions = t["orders"].select(
        F.col("o_orderpriority").alias("model_type"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at")
    )
    return decisions.newest_version(versions)


@query(
    "t5_last_rows",
    "SELECT zone, datetime FROM observed QUALIFY row_number() OVER (PARTITION BY zone ORDER BY datetime DESC) <= 5",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return latest_rows(t.grid_observed.select("zone", "datetime"), HOURLY, 5)


@query(
    "u1_union_by_name",
    f"""SELECT zone, datetime, {CI}, {LOAD}, NULL::DOUBLE AS temperature_2m_c FROM observed
UNION ALL SELECT zone, datetime, NULL, NULL, temperature_2m_c FROM weather""",
    ctes="observed weather",
)
def _(t: Tables) -> DataFrame:
    return clean.union_by_name(
        [t.grid_observed.select("zone", "datetime", CI, LOAD), t.weather.select("zone", "datetime", WEATHER_VALUES[0])]
    )


@query(
    "u2_horizons_long",
    f"""SELECT zone, datetime, unnest(['target_1h', 'target_24h']) AS target, unnest([{CI}, {LOAD}]) AS value FROM observed""",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    wide = t.grid_observed.select("zone", "datetime", F.col(CI).alias("target_1h"), F.col(LOAD).alias("target_24h"))
    return wide.unpivot(["zone", "datetime"], ["target_1h", "target_24h"], "target", "value")


@query(
    "u3_missing_columns",
    """SELECT "column" FROM (VALUES ('rain_mm'), ('temperature_2m_c')) v("column") WHERE (SELECT count(*) FROM events) > 0""",
)
def _(t: Tables) -> DataFrame:
    missing = features.missing_columns(t.grid_observed, [CI, "zone", "rain_mm", "temperature_2m_c"])
    some = t.grid_observed.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
    return some.select(F.explode(F.array(*[F.lit(c) for c in missing])).alias("column"))


@query("u4_shared_rows", "SELECT zone, datetime FROM observed INTERSECT SELECT zone, datetime FROM weather", ctes="observed weather")
def _(t: Tables) -> DataFrame:
    return t.grid_observed.select("zone", "datetime").intersect(t.weather.select("zone", "datetime"))


@query("u5_distinct_rows", "SELECT DISTINCT event_type AS zone, user_id FROM events")
def _(t: Tables) -> DataFrame:
    return t.readings.select("zone", "user_id").distinct()


@query(
    "u6_split_overlap",
    f"""SELECT zone, datetime, min(split) AS first_split, max(split) AS last_split
FROM (SELECT zone, datetime, {SPLIT_CASE} AS split FROM daily
  UNION ALL SELECT zone, datetime, 'test' FROM daily WHERE datetime >= TIMESTAMP '2000-06-01')
GROUP BY zone, datetime HAVING min(split) <> max(split)""",
    ctes="daily",
)
def _(t: Tables) -> DataFrame:
    whole = split.assign_split(t.daily_observed.select("zone", "datetime"), TRAIN_END, VAL_END)
    leaked = t.daily_observed.select("zone", "datetime").filter(F.col("datetime") >= F.lit("2000-06-01").cast("timestamp"))
    return split.split_overlap(whole.unionByName(leaked.withColumn("split", F.lit("test"))))


# --- scalar functions --------------------------------------------------------------

TEMPORAL_SQL = """CAST(hour(datetime) AS INTEGER) AS hour_of_day, CAST(isodow(datetime) - 1 AS INTEGER) AS day_of_week,
  CAST(month(datetime) AS INTEGER) AS month, CAST(isodow(datetime) >= 6 AS INTEGER) AS is_weekend,
  CAST(day(datetime) AS INTEGER) AS day_of_month, CAST(quarter(datetime) AS INTEGER) AS quarter,
  CAST(dayofyear(datetime) AS INTEGER) AS day_of_year, CAST(weekofyear(datetime) AS INTEGER) AS week_of_year,
  CAST(year(datetime) AS INTEGER) AS year"""
SEASON_SQL = """CASE WHEN month(datetime) IN (12, 1, 2) THEN 'Winter' WHEN month(datetime) IN (3, 4, 5) THEN 'Spring'
  WHEN month(datetime) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""


@query(
    "f1_calendar",
    f"SELECT zone, datetime, {TEMPORAL_SQL} FROM (SELECT event_type AS zone, ts AS datetime FROM events UNION ALL SELECT zone, datetime FROM daily)",
    ctes="daily",
)
def _(t: Tables) -> DataFrame:
    both = t["events"].select(F.col("event_type").alias("zone"), F.col("ts").alias("datetime")).unionByName(
        t.daily_observed.select("zone", "datetime")
    )
    columns = calendar.temporal_columns(F.col("datetime"))
    for later in ("is_daytime", "season"):
        columns.pop(later)
    return both.withColumns(columns)


@query(
    "f2_flags",
    """SELECT event_id, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(hour(ts) >= 6 AND hour(ts) < 18 AS INTEGER) AS is_daytime FROM events""",
)
def _(t: Tables) -> DataFrame:
    columns = calendar.temporal_columns(F.col("ts"))
    return t["events"].select("event_id", columns["is_weekend"].alias("is_weekend"), columns["is_daytime"].alias("is_daytime"))


@query(
    "f3_season",
    f"""SELECT zone, datetime, {SEASON_SQL} AS season, CASE WHEN month(datetime) IN (12, 1, 2) THEN 1 WHEN month(datetime) IN (3, 4, 5) THEN 2
  WHEN month(datetime) IN (6, 7, 8) THEN 3 ELSE 4 END AS season_number FROM daily""",
    ctes="daily",
)
def _(t: Tables) -> DataFrame:
    ts = F.col("datetime")
    return t.daily_observed.select("zone", "datetime", calendar.season_name(ts).alias("season"), calendar.season_number(ts).alias("season_number"))


@query(
    "f4_cyclic",
    """SELECT event_id, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos FROM events""",
    floats="hour_sin hour_cos month_sin month_cos dow_sin dow_cos",
)
def _(t: Tables) -> DataFrame:
    return t["events"].select("event_id", *[c.alias(n) for n, c in calendar.cyclic_columns(F.col("ts")).items()])


@query(
    "f5_solar_potential",
    """SELECT zone, datetime, CAST(hour(datetime) >= 6 AND hour(datetime) < 18 AS INTEGER) * (100 - cloud_cover_pct) / 100 AS solar_potential FROM weather""",
    floats="solar_potential",
    ctes="weather",
)
def _(t: Tables) -> DataFrame:
    day = calendar.temporal_columns(F.col("datetime"))["is_daytime"]
    return t.weather.select("zone", "datetime", scalars.solar_potential(day, F.col("cloud_cover_pct")).alias("solar_potential"))


@query(
    "f6_temperature_demand",
    f"SELECT zone, datetime, {LOAD} * abs(temperature_2m_c - 15) / 100 AS temp_demand_proxy FROM observed JOIN weather USING (zone, datetime)",
    floats="temp_demand_proxy",
    ctes="observed weather",
)
def _(t: Tables) -> DataFrame:
    both = clean.merge_on_key(t.grid_observed, t.weather)
    return both.select("zone", "datetime", scalars.temperature_demand(F.col(LOAD), F.col("temperature_2m_c")).alias("temp_demand_proxy"))


@query("f7_clean_energy_score", f"SELECT zone, datetime, ({CFE} + {REN}) / 2 AS clean_energy_score FROM observed", ctes="observed")
def _(t: Tables) -> DataFrame:
    return t.grid_observed.select("zone", "datetime", scalars.clean_energy_score(F.col(CFE), F.col(REN)).alias("clean_energy_score"))


@query(
    "f8_serve_features",
    f"""WITH b AS (SELECT zone, datetime, {CI}, lag({CI}) OVER w AS lag_1h, avg({CI}) OVER (PARTITION BY zone ORDER BY datetime ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS rolling_mean_4h,
  shortwave_radiation_wm2 * (1 - cloud_cover_pct / 100) AS solar_potential, abs(temperature_2m_c - 20) AS temp_demand_proxy,
  CAST(hour(datetime) BETWEEN 6 AND 20 AS INTEGER) AS is_daytime, 1 AS season FROM merged WINDOW w AS (PARTITION BY zone ORDER BY datetime))
SELECT zone, datetime, coalesce(lag_1h, first_value(lag_1h IGNORE NULLS) OVER (PARTITION BY zone ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lag_1h,
  rolling_mean_4h, solar_potential, temp_demand_proxy, is_daytime, season,
  coalesce({CI} - lag_1h, first_value({CI} - lag_1h IGNORE NULLS) OVER (PARTITION BY zone ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS carbon_change_1h FROM b""",
    floats="rolling_mean_4h solar_potential",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    built = features.build_features(t.merged, profile="serve")
    return built.select(
        "zone", "datetime", "lag_1h", "rolling_mean_4h", "solar_potential", "temp_demand_proxy", "is_daytime", "season", "carbon_change_1h"
    )


@query(
    "f9_slice_texts",
    f"""SELECT zone, datetime, CAST(hour(datetime) AS VARCHAR) AS hour_of_day, dayname(datetime) AS day_of_week,
  CAST(month(datetime) AS VARCHAR) AS month, {SEASON_SQL} AS season, CASE WHEN isodow(datetime) >= 6 THEN 'True' ELSE 'False' END AS is_weekend FROM daily""",
    ctes="daily",
)
def _(t: Tables) -> DataFrame:
    return t.daily_observed.select("zone", "datetime").withColumns(calendar.slice_text_columns(F.col("datetime")))


REPORT_LEVEL_SQL = """CASE WHEN coalesce({c}, 0) < 0 THEN 'nan' WHEN coalesce({c}, 0) <= 100 THEN 'Very Low' WHEN {c} <= 200 THEN 'Low'
  WHEN {c} <= 300 THEN 'Medium' WHEN {c} <= 400 THEN 'High' ELSE 'Very High' END"""


@query("f10_levels", f"SELECT zone, datetime, {LEVEL_SQL.format(c=CI)} AS carbon_bucket FROM axis", ctes="axis")
def _(t: Tables) -> DataFrame:
    return t.grid_axis.select("zone", "datetime", buckets.level(F.col(CI)).alias("carbon_bucket"))


@query("f11_report_levels", f"SELECT zone, datetime, {REPORT_LEVEL_SQL.format(c=CI)} AS carbon_bucket FROM axis", ctes="axis")
def _(t: Tables) -> DataFrame:
    return t.grid_axis.select("zone", "datetime", buckets.report_level(F.col(CI)).alias("carbon_bucket"))


LEVEL_INDEX_SQL = "(CAST({c} >= 100 AS INTEGER) + CAST({c} >= 200 AS INTEGER) + CAST({c} >= 350 AS INTEGER) + CAST({c} >= 500 AS INTEGER))"


@query(
    "f12_level_index",
    f"""SELECT row_id, {LEVEL_INDEX_SQL.format(c='actual')} AS level,
  list_extract(['Very Low (<100)', 'Low (100-200)', 'Medium (200-350)', 'High (350-500)', 'Very High (500+)'], {LEVEL_INDEX_SQL.format(c='predicted')} + 1) AS served
FROM scores""",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return t.scores.select(
        "row_id", buckets.level_index(F.col("actual")).alias("level"), buckets.service_level(F.col("predicted")).alias("served")
    )


@query(
    "f13_improvement_tier",
    """SELECT row_id, round_even((actual - predicted) / nullif(actual, 0) * 100, 2) AS improvement_pct,
  CASE WHEN actual = 0 THEN 'unknown' WHEN (actual - predicted) / actual >= 0.60 THEN 'excellent' WHEN (actual - predicted) / actual >= 0.45 THEN 'good'
    WHEN (actual - predicted) / actual >= 0.25 THEN 'fair' ELSE 'poor' END AS tier FROM scores""",
    floats="improvement_pct",
    digits=3,
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    base, mae = F.col("actual"), F.col("predicted")
    return t.scores.select(
        "row_id", buckets.improvement_pct(base, mae).alias("improvement_pct"), buckets.performance_tier(mae, base).alias("tier")
    )


@query(
    "f14_co2_kg",
    "SELECT job_id, (100 + runtime_hours) * energy_kwh / 1000 AS kg FROM jobs",
    floats="kg",
    ctes="jobs",
)
def _(t: Tables) -> DataFrame:
    return t.jobs.select("job_id", scalars.co2_kg(F.col("runtime_hours") + 100, F.col("energy_kwh")).alias("kg"))


@query(
    "f15_co2_kg_for_power",
    "SELECT job_id, (100 + flexibility_hours) * energy_kwh * runtime_hours / 1000 AS kg FROM jobs",
    floats="kg",
    ctes="jobs",
)
def _(t: Tables) -> DataFrame:
    return t.jobs.select(
        "job_id", scalars.co2_kg_for_power(F.col("flexibility_hours") + 100, F.col("energy_kwh"), F.col("runtime_hours")).alias("kg")
    )


@query(
    "f16_metric_keys",
    f"""SELECT row_id, weather, 'weather_condition__' || replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  weather, ' ', '_'), '/', '_'), '(', ''), ')', ''), '+', 'plus'), '%', 'pct'), '<', 'lt'), '>', 'gt'), '=', 'eq'), '-', ''), '.', '') AS key
FROM ({WEATHER_SQL})""",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    named = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in weather_classes().items()]))
    rows = t.scores.select("row_id", F.explode(named).alias("weather"))
    return rows.withColumn("key", scalars.metric_key(F.lit("weather_condition"), F.col("weather")))


@query(
    "f16_signed_percent",
    "SELECT row_id, printf('%+.1f%%', (predicted - actual) / 128 * 100) AS pct FROM scores",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return t.scores.select("row_id", scalars.signed_percent((F.col("predicted") - F.col("actual")) / 128).alias("pct"))


@query(
    "f17_errors",
    "SELECT row_id, round_even(predicted - actual, 2) AS error, abs(round_even(predicted - actual, 2)) AS abs_error FROM scores",
    floats="error abs_error",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    return with_errors(t.scores).select("row_id", "error", "abs_error")


@query(
    "f18_advice",
    """SELECT zone, run, datetime, CASE WHEN predicted_carbon_intensity <= quantile_cont(predicted_carbon_intensity, 0.25) OVER (PARTITION BY zone, run)
  THEN '✅ SCHEDULE NOW — Low carbon' ELSE '⏳ DEFER — High carbon' END AS recommendation FROM forecasts""",
    ctes="forecasts",
)
def _(t: Tables) -> DataFrame:
    marked = schedule.mark_green(t.forecasts, RUNS)
    return marked.select("zone", "run", "datetime", scalars.advice(F.col("is_green")).alias("recommendation"))


@query(
    "f19_rarity_weights",
    f"SELECT zone, datetime, CASE WHEN {CI} < 100 THEN 3.0::DOUBLE WHEN {CI} < 200 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM observed",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return t.grid_observed.select("zone", "datetime", buckets.rarity_weight(F.col(CI)).alias("weight"))


@query(
    "f20_zone_weights",
    """SELECT event_id, CASE WHEN event_type = 'view' AND value >= 10 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM events""",
)
def _(t: Tables) -> DataFrame:
    synthetic = F.col("value") < 10
    return t["events"].select("event_id", buckets.zone_weight(F.col("event_type"), "view", synthetic=synthetic).alias("weight"))


@query(
    "f21_json_maps",
    """SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events""",
)
def _(t: Tables) -> DataFrame:
    """Keys and values of a JSON object column."""
    mix = F.from_json("props", "map<string,double>")
    return t["events"].select("event_id", F.explode(mix).alias("key", "value"))


@query(
    "f22_min_max_scaled",
    """WITH m AS (SELECT model, horizon_hours, zone, avg(abs(actual - predicted)) AS mae FROM scores GROUP BY 1, 2, 3)
SELECT model, horizon_hours, zone, (mae - min(mae) OVER w) / nullif(max(mae) OVER w - min(mae) OVER w, 0) AS scaled
FROM m WINDOW w AS (PARTITION BY model, horizon_hours)""",
    floats="scaled",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    by = ["model", "horizon_hours"]
    mae = t.scores.groupBy(*by, "zone").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    return mae.select(*by, "zone", scalars.min_max_scaled(F.col("mae"), by).alias("scaled"))


@query(
    "f23_first_metric",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE floor(o_totalprice) END AS mae,
  NULL::DOUBLE AS rmse, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE END AS r2, NULL::DOUBLE AS mape FROM orders""",
    floats="mae",
)
def _(t: Tables) -> DataFrame:
    return decisions.standard_metrics(run_log(t))


def run_log(t: Tables) -> DataFrame:
    """A run per order: a tag map and a metric map. Some runs only have the plain metric."""
    tested = F.col("o_orderstatus") == "F"
    price = F.col("o_totalprice")
    return t["orders"].select(
        F.col("o_orderkey").alias("run_id"),
        F.when(tested, F.create_map(F.lit("test_mae"), price, F.lit("mae"), F.lit(0.0), F.lit("test_r2"), F.lit(1.0)))
        .otherwise(F.create_map(F.lit("mae"), F.floor(price).cast("double")))
        .alias("metrics"),
        F.when(tested, F.create_map(F.lit("model_type"), F.col("o_orderpriority")))
        .otherwise(F.create_map(F.lit("horizon_h"), F.lit("12")))
        .alias("tags"),
    )


@query(
    "f23_run_table",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'unknown' END AS model_type,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE '12' END AS horizon_h, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS test_mae, NULL::DOUBLE AS val_mae FROM orders""",
    floats="test_mae",
)
def _(t: Tables) -> DataFrame:
    return decisions.run_table(run_log(t), {"model_type": "unknown", "horizon_h": ""}, ["test_mae", "val_mae"])


@query(
    "f24_status_texts",
    """WITH c AS (SELECT zone, count(*) AS n FROM scores GROUP BY zone), s AS (SELECT zone, n * 100.0 / sum(n) OVER () AS pct FROM c)
SELECT zone, CASE WHEN pct < 19.9 THEN 'Under' WHEN pct > 20.1 THEN 'Over' ELSE 'OK' END AS status FROM s""",
    ctes="scores",
)
def _(t: Tables) -> DataFrame:
    counts = t.scores.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("_one"))
    total = counts.groupBy("_one").agg(F.sum("n").alias("total"))
    # One row of totals.
    shares = counts.join(F.broadcast(total), "_one").withColumn("pct", F.col("n") * 100.0 / F.col("total"))
    return shares.select("zone", buckets.representation_status(F.col("pct") < 19.9, F.col("pct") > 20.1).alias("status"))


@query(
    "f25_tone",
    f"SELECT zone, datetime, CASE WHEN {CI} < 160 THEN 'green' WHEN {CI} < 230 THEN 'amber' ELSE 'red' END AS tone FROM observed",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return t.grid_observed.select("zone", "datetime", buckets.tone(F.col(CI)).alias("tone"))


FEATURE_COLUMNS = [
    *[f"{c}_lag_{n}h" for c in features.TRAIN.lag_columns for n in features.TRAIN.lags],
    *[f"{c}_{s}_{n}h" for c, w in features.TRAIN.rolling.items() for n, stats in w.items() for s in stats],
    "carbon_change_1h",
    "load_variability",
]


def _feature_sql() -> str:
    over = "OVER (PARTITION BY zone ORDER BY datetime"
    made = []
    for c in features.TRAIN.lag_columns:
        made += [f"lag({c}, {n}) {over}) AS {c}_lag_{n}h" for n in features.TRAIN.lags]
    names = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    for c, windows in features.TRAIN.rolling.items():
        for n, stats in windows.items():
            made += [f"{names[s]}({c}) {over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_{s}_{n}h" for s in stats]
    made.append(f"coalesce({CI} - lag({CI}) {over}), 0) AS carbon_change_1h")
    frame = f"{over} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    made.append(f"CASE WHEN count({LOAD}) {frame} = 24 THEN stddev_samp({LOAD}) {frame} ELSE 0 END AS load_variability")
    filled = [
        f"coalesce({c}, first_value({c} IGNORE NULLS) {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), "
        f"last_value({c} IGNORE NULLS) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}"
        for c in FEATURE_COLUMNS
    ]
    return (
        f"WITH w AS (SELECT zone, datetime, cloud_cover_pct, {', '.join(made)} FROM merged)\nSELECT zone, datetime, "
        + ", ".join(filled)
        + ", CAST(hour(datetime) >= 6 AND hour(datetime) < 18 AS INTEGER) * (100 - cloud_cover_pct) / 100 AS solar_potential FROM w"
    )


@query(
    "feature_table",
    _feature_sql(),
    floats=" ".join(c for c in FEATURE_COLUMNS if "_mean_" in c or "_std_" in c) + " load_variability solar_potential",
    digits=5,
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """All window features of the training profile with their fill, in one plan."""
    return features.build_features(t.merged).select("zone", "datetime", *FEATURE_COLUMNS, "solar_potential")


USER_SUMS = [c for c in FEATURE_COLUMNS if "_std_" not in c and c != "load_variability"]


def _user_feature_sql() -> str:
    over = "OVER (PARTITION BY zone ORDER BY datetime"
    names = {"mean": "avg", "min": "min", "max": "max"}
    made = [f"coalesce(lag({c}, {n}) {over}), 0) AS {c}_lag_{n}h" for c in features.TRAIN.lag_columns for n in features.TRAIN.lags]
    for c, windows in features.TRAIN.rolling.items():
        for n, stats in windows.items():
            made += [f"{names[s]}({c}) {over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_{s}_{n}h" for s in stats if s != "std"]
    made.append(f"coalesce({CI} - lag({CI}) {over}), 0) AS carbon_change_1h")
    sums = ", ".join(f"sum({c}) AS {c}" for c in USER_SUMS)
    return f"SELECT zone, count(*) AS rows, {sums} FROM (SELECT zone, datetime, {', '.join(made)} FROM user_series) GROUP BY zone"


@query("feature_sums_by_user", _user_feature_sql(), floats=" ".join(USER_SUMS), digits=4, ctes="user_series")
def _(t: Tables) -> DataFrame:
    """Window features of every user's series, added up per user."""
    empty = {c: F.lit(0.0) for c in (CFE, REN, "cloud_cover_pct")}
    built = features.build_features(t.user_series.withColumns(empty), fill="causal")
    return built.groupBy("zone").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in USER_SUMS])


@query(
    "entry_latest_green_windows",
    """WITH tail AS (SELECT zone, datetime, carbon_intensity_gco2_per_kwh AS predicted_carbon_intensity FROM grid
  QUALIFY row_number() OVER (PARTITION BY zone ORDER BY datetime DESC) <= 24),
limits AS (SELECT zone, quantile_cont(predicted_carbon_intensity, 0.25) AS threshold FROM tail GROUP BY zone),
marked AS (SELECT f.*, predicted_carbon_intensity <= threshold AS is_green FROM tail f JOIN limits USING (zone)),
steps AS (SELECT *, CASE WHEN is_green AND NOT coalesce(lag(is_green) OVER (PARTITION BY zone ORDER BY datetime), false) THEN 1 ELSE 0 END AS opened FROM marked),
numbered AS (SELECT *, sum(opened) OVER (PARTITION BY zone ORDER BY datetime) AS island FROM steps)
SELECT zone, min(datetime) AS start_time, max(datetime) AS end_time, count(*) AS duration_hours,
  round_even(avg(predicted_carbon_intensity), 2) AS avg_intensity, round_even(min(predicted_carbon_intensity), 2) AS min_intensity,
  round_even(max(predicted_carbon_intensity), 2) AS max_intensity
FROM numbered WHERE is_green GROUP BY zone, island""",
    floats="avg_intensity min_intensity max_intensity",
    ctes="grid",
)
def _(t: Tables) -> DataFrame:
    tail = latest_rows(t.grid, HOURLY, 24).select("zone", "datetime", F.col(CI).alias("predicted_carbon_intensity"))
    day = Series(short_keys=True)
    return schedule.green_windows(schedule.mark_green(tail, day), day)
