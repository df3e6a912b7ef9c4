"""The driver tables read as grid, weather, score and job tables.

Values are whole numbers (or halves) wherever they are summed later, so that sums do
not depend on the order of rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.clean import merge_on_key
from tidemark.operators.series import Series, regularise, regularise_and_fill

HOURLY = Series()
DAILY = Series(step_seconds=86_400)
# One forecast run holds 24 hours.
RUNS = Series(keys=("zone", "run"), short_keys=True)
GRID_VALUES = (
    "carbon_intensity_gco2_per_kwh",
    "carbon_free_energy_pct",
    "carbon_intensity_fossil_gco2_per_kwh",
    "renewable_energy_pct",
    "total_load_mw",
    "net_load_mw",
)
WEATHER_VALUES = (
    "temperature_2m_c",
    "wind_speed_100m_ms",
    "cloud_cover_pct",
    "shortwave_radiation_wm2",
    "rain_mm",
    "snowfall_cm",
    "weather_code",
)
# Event types in name order.
ZONES = ("click", "error", "purchase", "signup", "view")
HORIZONS = (1, 12, 24)
TRAIN_END, VAL_END = "1999-06-30 23:00:00", "2000-06-30 23:00:00"


class Tables:
    """Lazy access to the tables of one scale folder and the series read from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        """A table with its times as UTC timestamps."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        times = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"}
        return df.withColumns(times) if times else df

    @cached_property
    def readings(self) -> DataFrame:
        """One row per event: zone, hour and the reading's parts."""
        return self["events"].select(
            F.col("event_type").alias("zone"),
            F.date_trunc("hour", "ts").alias("datetime"),
            "ts",
            "event_id",
            "user_id",
            F.floor("value").alias("whole"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def grid_observed(self) -> DataFrame:
        """Hourly grid values; hours without events are missing."""
        return self.readings.groupBy("zone", "datetime").agg(
            F.pmod(F.sum(F.col("whole") * 7 + F.col("user_id")), F.lit(650)).cast("double").alias(GRID_VALUES[0]),
            F.min("k").cast("double").alias(GRID_VALUES[1]),
            F.max("whole").cast("double").alias(GRID_VALUES[2]),
            F.max("k").cast("double").alias(GRID_VALUES[3]),
            F.sum("user_id").cast("double").alias(GRID_VALUES[4]),
            (F.sum("user_id") - 10 * F.count(F.lit(1))).cast("double").alias(GRID_VALUES[5]),
        )

    @cached_property
    def grid_axis(self) -> DataFrame:
        return regularise(self.grid_observed, HOURLY)

    @cached_property
    def grid(self) -> DataFrame:
        """Regular and filled."""
        return regularise_and_fill(self.grid_observed, HOURLY, GRID_VALUES)

    @cached_property
    def user_series(self) -> DataFrame:
        """One regular, filled series per user: many keys, most hours empty."""
        hour = self.readings.groupBy(F.col("user_id").cast("string").alias("zone"), "datetime").agg(
            F.sum("whole").cast("double").alias(GRID_VALUES[0]),
            F.count(F.lit(1)).cast("double").alias(GRID_VALUES[4]),
            F.max("k").cast("double").alias(WEATHER_VALUES[0]),
            F.min("k").cast("double").alias(WEATHER_VALUES[1]),
        )
        return regularise_and_fill(hour, HOURLY, [GRID_VALUES[0], GRID_VALUES[4], WEATHER_VALUES[0], WEATHER_VALUES[1]])

    @cached_property
    def weather(self) -> DataFrame:
        """Hourly weather of each zone, from order lines."""
        zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.pmod("l_partkey", F.lit(5)) + 1).cast("int"))
        hours = F.pmod("l_orderkey", F.lit(720)).cast("int")
        return (
            self["lineitem"]
            .groupBy(
                zone.alias("zone"),
                (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), hours)).alias("datetime"),
            )
            .agg(
                (F.pmod(F.sum(F.col("l_quantity").cast("long")), F.lit(50)) - 10).cast("double").alias(WEATHER_VALUES[0]),
                F.pmod(F.sum(F.round(F.col("l_tax") * 100).cast("long")), F.lit(20)).cast("double").alias(WEATHER_VALUES[1]),
                F.pmod(F.sum(F.round(F.col("l_discount") * 100).cast("long")), F.lit(101)).cast("double").alias(WEATHER_VALUES[2]),
                (F.pmod(F.sum("l_linenumber"), F.lit(10)) * 100).cast("double").alias(WEATHER_VALUES[3]),
                F.pmod(F.count(F.lit(1)), F.lit(5)).cast("double").alias(WEATHER_VALUES[4]),
                F.pmod(F.sum("l_suppkey"), F.lit(7)).cast("double").alias(WEATHER_VALUES[5]),
                F.pmod(F.sum("l_suppkey"), F.lit(100)).cast("double").alias(WEATHER_VALUES[6]),
            )
        )

    @cached_property
    def merged(self) -> DataFrame:
        """Filled grid with filled weather: gap-free per zone."""
        weather = regularise_and_fill(self.weather, HOURLY, WEATHER_VALUES)
        return merge_on_key(self.grid, weather)

    @cached_property
    def daily_observed(self) -> DataFrame:
        """Daily series over several years: one zone per order priority."""
        return (
            self["orders"]
            .groupBy(F.col("o_orderpriority").alias("zone"), F.col("o_orderdate").alias("datetime"))
            .agg(
                F.pmod(F.sum(F.floor("o_totalprice")), F.lit(650)).cast("double").alias(GRID_VALUES[0]),
                F.count(F.lit(1)).cast("double").alias(GRID_VALUES[4]),
            )
        )

    @cached_property
    def scores(self) -> DataFrame:
        """One forecast per order, with what its slices need."""
        order, customer = F.col("o_orderkey"), F.col("o_custkey")
        return self["orders"].select(
            F.col("o_orderpriority").alias("zone"),
            F.col("o_orderdate").alias("datetime"),
            order.alias("row_id"),
            F.element_at(F.array(*[F.lit(h) for h in HORIZONS]), (F.pmod(customer, F.lit(3)) + 1).cast("int")).alias("horizon_hours"),
            F.when(F.col("o_orderstatus") == "F", "gbt_tuned").otherwise("gbt_base").alias("model"),
            F.floor(F.col("o_totalprice") / 800).cast("double").alias("actual"),
            (F.floor(F.col("o_totalprice") / 800) + F.pmod(customer * 37 + order, F.lit(121)) - 60).cast("double").alias("predicted"),
            (F.pmod(customer, F.lit(45)) - 10).cast("double").alias("temperature_2m_c"),
            F.pmod(order, F.lit(20)).cast("double").alias("wind_speed_100m_ms"),
            F.pmod(customer * 7, F.lit(101)).cast("double").alias("cloud_cover_pct"),
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """24-hour forecasts: one run per zone and day, from the filled grid."""
        return self.grid.select(
            "zone",
            F.col("datetime").cast("date").cast("string").alias("run"),
            "datetime",
            F.col(GRID_VALUES[0]).alias("predicted_carbon_intensity"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """One job per order: zone and day from its keys, runtime and patience from its customer."""
        zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.pmod("o_custkey", F.lit(5)) + 1).cast("int"))
        day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("o_orderkey", F.lit(28)).cast("int"))
        return self["orders"].select(
            F.col("o_orderkey").alias("job_id"),
            zone.alias("zone"),
            day.cast("string").alias("run"),
            (F.pmod("o_custkey", F.lit(6)) + 1).cast("int").alias("runtime_hours"),
            F.pmod("o_orderkey", F.lit(24)).alias("flexibility_hours"),
            (F.pmod("o_orderkey", F.lit(200)) + 20).cast("double").alias("energy_kwh"),
        )


_FILL = """coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY zone ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value({c} IGNORE NULLS) OVER (PARTITION BY zone ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""


def filled_sql(columns: tuple[str, ...], source: str) -> str:
    return "SELECT zone, datetime, " + ",\n".join(_FILL.format(c=c) for c in columns) + f"\nFROM {source}"


def axis_sql(source: str) -> str:
    return f"""SELECT a.zone, a.datetime, o.* EXCLUDE (zone, datetime) FROM (
  SELECT zone, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS datetime
  FROM (SELECT zone, min(datetime) AS lo, max(datetime) AS hi FROM {source} GROUP BY zone)) a
LEFT JOIN {source} o ON a.zone = o.zone AND a.datetime = o.datetime"""


# name -> (inputs, text): the same tables in SQL.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "readings": (
        (),
        """SELECT event_type AS zone, date_trunc('hour', ts) AS datetime, ts, event_id, user_id,
  CAST(floor(value) AS BIGINT) AS whole, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    ),
    "observed": (
        ("readings",),
        """SELECT zone, datetime,
  CAST(sum(whole * 7 + user_id) % 650 AS DOUBLE) AS carbon_intensity_gco2_per_kwh,
  CAST(min(k) AS DOUBLE) AS carbon_free_energy_pct,
  CAST(max(whole) AS DOUBLE) AS carbon_intensity_fossil_gco2_per_kwh,
  CAST(max(k) AS DOUBLE) AS renewable_energy_pct,
  CAST(sum(user_id) AS DOUBLE) AS total_load_mw,
  CAST(sum(user_id) - 10 * count(*) AS DOUBLE) AS net_load_mw
FROM readings GROUP BY zone, datetime""",
    ),
    "axis": (("observed",), axis_sql("observed")),
    "grid": (("axis",), filled_sql(GRID_VALUES, "axis")),
    "weather": (
        (),
        """SELECT list_extract(['click','error','purchase','signup','view'], CAST(l_partkey % 5 + 1 AS INTEGER)) AS zone,
  TIMESTAMP '2024-01-01' + to_hours(CAST(l_orderkey % 720 AS INTEGER)) AS datetime,
  CAST(sum(CAST(l_quantity AS BIGINT)) % 50 - 10 AS DOUBLE) AS temperature_2m_c,
  CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) % 20 AS DOUBLE) AS wind_speed_100m_ms,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 101 AS DOUBLE) AS cloud_cover_pct,
  CAST(sum(l_linenumber) % 10 * 100 AS DOUBLE) AS shortwave_radiation_wm2,
  CAST(count(*) % 5 AS DOUBLE) AS rain_mm,
  CAST(sum(l_suppkey) % 7 AS DOUBLE) AS snowfall_cm,
  CAST(sum(l_suppkey) % 100 AS DOUBLE) AS weather_code
FROM lineitem GROUP BY 1, 2""",
    ),
    "weather_axis": (("weather",), axis_sql("weather")),
    "weather_filled": (("weather_axis",), filled_sql(WEATHER_VALUES, "weather_axis")),
    "merged": (("grid", "weather_filled"), "SELECT * FROM grid JOIN weather_filled USING (zone, datetime)"),
    "daily": (
        (),
        """SELECT o_orderpriority AS zone, o_orderdate AS datetime,
  CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) % 650 AS DOUBLE) AS carbon_intensity_gco2_per_kwh,
  CAST(count(*) AS DOUBLE) AS total_load_mw
FROM orders GROUP BY 1, 2""",
    ),
    "scores": (
        (),
        """SELECT o_orderpriority AS zone, o_orderdate AS datetime, o_orderkey AS row_id,
  list_extract([1, 12, 24], CAST(o_custkey % 3 + 1 AS INTEGER)) AS horizon_hours,
  CASE WHEN o_orderstatus = 'F' THEN 'gbt_tuned' ELSE 'gbt_base' END AS model,
  CAST(floor(o_totalprice / 800) AS DOUBLE) AS actual,
  CAST(floor(o_totalprice / 800) + (o_custkey * 37 + o_orderkey) % 121 - 60 AS DOUBLE) AS predicted,
  CAST(o_custkey % 45 - 10 AS DOUBLE) AS temperature_2m_c,
  CAST(o_orderkey % 20 AS DOUBLE) AS wind_speed_100m_ms,
  CAST((o_custkey * 7) % 101 AS DOUBLE) AS cloud_cover_pct
FROM orders""",
    ),
    "user_hours": (
        ("readings",),
        """SELECT CAST(user_id AS VARCHAR) AS zone, datetime, CAST(sum(whole) AS DOUBLE) AS carbon_intensity_gco2_per_kwh,
  CAST(count(*) AS DOUBLE) AS total_load_mw, CAST(max(k) AS DOUBLE) AS temperature_2m_c, CAST(min(k) AS DOUBLE) AS wind_speed_100m_ms
FROM readings GROUP BY 1, 2""",
    ),
    "user_axis": (("user_hours",), axis_sql("user_hours")),
    "user_series": (
        ("user_axis",),
        filled_sql((GRID_VALUES[0], GRID_VALUES[4], WEATHER_VALUES[0], WEATHER_VALUES[1]), "user_axis"),
    ),
    "forecasts": (
        ("grid",),
        """SELECT zone, CAST(CAST(datetime AS DATE) AS VARCHAR) AS run, datetime,
  carbon_intensity_gco2_per_kwh AS predicted_carbon_intensity FROM grid""",
    ),
    "jobs": (
        (),
        """SELECT o_orderkey AS job_id,
  list_extract(['click','error','purchase','signup','view'], CAST(o_custkey % 5 + 1 AS INTEGER)) AS zone,
  CAST(DATE '2024-01-01' + CAST(o_orderkey % 28 AS INTEGER) AS VARCHAR) AS run,
  CAST(o_custkey % 6 + 1 AS INTEGER) AS runtime_hours,
  o_orderkey % 24 AS flexibility_hours,
  CAST(o_orderkey % 200 + 20 AS DOUBLE) AS energy_kwh
FROM orders""",
    ),
}
