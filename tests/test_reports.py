"""Buckets, distributions, quantiles, resampling, gates, schedules, files and streams."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import buckets, scalars
from tidemark.operators import decisions, metrics, profile, quality, ranks, resample, schedule, series
from tidemark.operators.series import Series
from tidemark.session import scratch_path
from tidemark.sources import landing, tables
from tidemark.streaming import hourly

START = dt.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "value,name",
    [(50, "Very Low"), (99, "Very Low"), (100, "Low"), (199, "Low"), (200, "Medium"), (349, "Medium"), (350, "High"), (499, "High"), (500, "Very High"), (1000, "Very High"), (None, "Unknown"), (-1, "Unknown")],
)
def test_levels(spark, value, name):
    assert one(spark, buckets.level(F.lit(value).cast("double"))) == name


@pytest.mark.parametrize("value,name", [(0, "Very Low"), (100, "Very Low"), (100.5, "Low"), (300, "Medium"), (400, "High"), (401, "Very High"), (None, "Very Low")])
def test_report_levels(spark, value, name):
    assert one(spark, buckets.report_level(F.lit(value).cast("double"))) == name


@pytest.mark.parametrize("ratio,name", [(1, "LOW"), (2, "LOW"), (3, "MODERATE"), (5, "MODERATE"), (6, "HIGH"), (10, "HIGH"), (11, "SEVERE"), (100, "SEVERE")])
def test_severity(spark, ratio, name):
    assert one(spark, buckets.severity(F.lit(float(ratio)))) == name


def test_distribution_of_known_counts(spark):
    # Counts per level and the shares they must give.
    counts = {"High": 34233, "Low": 11764, "Medium": 17477, "Very High": 45493, "Very Low": 4937}
    expected = {
        "High": (30.05, 20.0, 50.25, False, True),
        "Low": (10.33, 20.0, -48.35, False, False),
        "Medium": (15.34, 20.0, -23.3, False, False),
        "Very High": (39.94, 20.0, 99.7, False, True),
        "Very Low": (4.33, 20.0, -78.35, True, False),
    }
    df = spark.createDataFrame(list(counts.items()), "level string, n int").select("level", F.explode(F.sequence(F.lit(1), "n")))
    got = {r["slice_value"]: tuple(r)[3:] for r in profile.slice_distribution(df, ["level"]).collect()}
    assert got == expected


def test_quantiles_with_a_hot_group(spark):
    rng = random.Random(1)
    data = {"hot": [rng.choice([7.0, 7.0, rng.random() * 100]) for _ in range(20_000)], "few": [1.0, 2.0], "one": [5.0]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["quantile"]): r["value"] for r in ranks.exact_quantiles(df, ["g"], "v", qs, splits=32).collect()}
    for g, vs in data.items():
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(vs, q))
    assert ranks.quantile_columns(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(sum(data.values(), [])))


def test_oversample(spark):
    rows = [("A", i) for i in range(100)] + [("B", i) for i in range(50)] + [("C", i) for i in range(10)]
    df = spark.createDataFrame(rows, "label string, id int")
    out = resample.oversample(df, "label", ["id"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"A": 100, "B": 100, "C": 100}
    assert out.distinct().count() == 160 and out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, resample.oversample(df, "label", ["id"]).collect()))
    only = df.filter("label = 'A'")
    assert resample.oversample(only, "label", ["id"]).count() == 100


def test_noisy_oversample(spark):
    df = spark.createDataFrame([("L", i, float(i)) for i in range(20)] + [("H", 99, 5.0)], "label string, id int, x double")
    out = resample.oversample_with_noise(df, "label", "L", 300, ["id"], ["x"])
    made = out.filter("is_synthetic")
    assert out.filter("label = 'L'").count() == 300 and made.count() == 280
    drift = made.select(F.max(F.abs(F.col("x") - F.col("id")))).first()[0]
    assert 0 < drift < 5 * 0.01 * np.std(range(20), ddof=1)


def test_permutation_importance_finds_the_driver(spark):
    from tidemark.operators import model

    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, noise double").withColumn("y", F.col("x") * 100)
    params = model.TreeParams(trees=3, depth=3, step=0.5, subsample=1.0, columns=1.0)
    fitted = model.fit_horizon(df, None, ["x", "noise"], "y", params)
    got = {r["feature"]: r["mae_increase"] for r in model.permutation_importance(fitted, df, ["x", "noise"], "y", ["id"]).collect()}
    assert got["x"] > 10 and abs(got["noise"]) < 2


def weather(spark, zones=("A",), **change):
    rows = [(START + dt.timedelta(hours=i), z, 15.0, 50) for z in zones for i in range(10)]
    df = spark.createDataFrame(rows, "datetime timestamp, zone string, temperature_2m_c double, cloud_cover_pct int")
    return df.withColumns({k: F.lit(v) for k, v in change.items()})


def test_schema_gate(spark):
    base = quality.infer_baseline(weather(spark))
    cases = {
        "good": (weather(spark), "PASSED"),
        "dropped": (weather(spark).drop("cloud_cover_pct"), "FAILED"),
        "text": (weather(spark, temperature_2m_c="warm"), "FAILED"),
        "zone": (weather(spark, ("A", "Z")), "FAILED"),
        "empty": (weather(spark).limit(0), "FAILED"),
    }
    gate = quality.schema_gate({n: df for n, (df, _) in cases.items()}, {n: base for n in cases})
    assert {r["dataset"]: r["status"] for r in gate.collect()} == {n: s for n, (_, s) in cases.items()}
    with pytest.raises(ValueError):
        quality.require_passed(gate)
    missing = {r["dataset"]: r["status"] for r in quality.schema_gate({"a": None, "b": weather(spark)}, {"a": base}).collect()}
    assert missing == {"a": "SKIPPED", "b": "SKIPPED"}
    assert quality.schema_gate({"a": None}, {}, strict=True).first()["status"] == "FAILED"


def test_drift_is_visible(spark):
    warm = weather(spark).withColumn("temperature_2m_c", F.col("temperature_2m_c") + 10)
    assert quality.drift_table(warm, weather(spark), ["temperature_2m_c"]).first()["mean_change"] == 10


FORECAST = [
    324.28, 328.3, 369.09, 377.51, 302.8, 308.67, 382.33, 395.95, 365.29, 342.11, 348.65, 333.63,
    417.6, 392.34, 370.13, 338.13, 373.19, 391.76, 284.15, 304.66, 361.93, 364.08, 359.72, 337.15,
]  # fixed values: a published day forecast
GREEN = {0, 1, 4, 5, 18, 19}


def forecast(spark, numbers=FORECAST):
    rows = [("P", START + dt.timedelta(hours=i), v) for i, v in enumerate(numbers)]
    return spark.createDataFrame(rows, "zone string, datetime timestamp, predicted_carbon_intensity double")


@pytest.mark.parametrize("s", [Series(short_keys=True), Series(chunk_steps=5)])
def test_green_hours_of_a_known_forecast(spark, s):
    marked = schedule.mark_green(forecast(spark), s)
    assert marked.first()["threshold"] == pytest.approx(332.2975)
    assert {r["datetime"].hour for r in marked.filter("is_green").collect()} == GREEN
    runs = schedule.green_windows(marked, s).orderBy("start_time").collect()
    assert [(r["start_time"].hour, r["duration_hours"]) for r in runs] == [(0, 2), (4, 2), (18, 2)]


@pytest.mark.parametrize("runtime,flexibility", [(1, None), (3, 12), (4, 2), (24, 5), (2, 0)])
@pytest.mark.parametrize("s", [Series(short_keys=True), Series(chunk_steps=5)])
def test_best_start_against_brute_force(spark, s, runtime, flexibility):
    latest = min(24 - runtime, 24 if flexibility is None else flexibility)
    means = [np.mean(FORECAST[i : i + runtime]) for i in range(latest + 1)]
    job = spark.createDataFrame([("P", runtime, flexibility, 100.0)], "zone string, runtime_hours int, flexibility_hours long, energy_kwh double")
    got = schedule.plan_jobs(job, schedule.start_options(forecast(spark), s, [runtime])).first()
    assert got["hours_to_wait"] == int(np.argmin(means))
    assert got["expected_intensity"] == pytest.approx(min(means), abs=0.006)


def test_ties_start_early_and_long_jobs_have_no_plan(spark):
    flat = forecast(spark, [10.0] * 5)
    jobs = spark.createDataFrame([("P", 2, 3, 1.0), ("P", 9, 3, 1.0)], "zone string, runtime_hours int, flexibility_hours long, energy_kwh double")
    options = schedule.start_options(flat, Series(short_keys=True), [2, 9])
    got = {r["runtime_hours"]: r["hours_to_wait"] for r in schedule.plan_jobs(jobs, options).collect()}
    assert got == {2: 0, 9: None}
    with pytest.raises(Exception, match="too short"):
        schedule.plan_jobs(jobs, options, strict=True).collect()


def test_comparison_keeps_one_sided_slices(spark):
    a = spark.createDataFrame([("zone", "A", 10.0, 0.5)], "slice_type string, slice_value string, mae double, r2 double")
    b = spark.createDataFrame([("zone", "A", 8.0, 0.6), ("zone", "B", 1.0, 0.1)], "slice_type string, slice_value string, mae double, r2 double")
    got = {r["slice_value"]: r["mae_improvement_pct"] for r in decisions.compare_slices(a, b).collect()}
    assert got == {"A": 20.0, "B": None}


def test_metric_keys(spark):
    assert one(spark, scalars.metric_key(F.lit("weather_condition"), F.lit("Windy (>= 10 m/s)"))) == "weather_condition__Windy_gteq_10_m_s"
    assert one(spark, scalars.parse_percent(F.lit("+12.3%"))) == 12.3
    assert one(spark, scalars.parse_percent(F.lit("n/a"))) is None


def test_scores_of_perfect_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", None, 5.0)], "m string, actual double, predicted double")
    r = metrics.scores(df, ["m"]).first()
    assert (r["mae"], r["rmse"], r["r2"]) == (0, 0, 1)


def test_file_level_skip(spark, tmp_path):
    folder = tmp_path / "backfill" / "zone=A" / "total-load"
    folder.mkdir(parents=True)
    names = ["start=20240101T000000Z_end=20240102T000000Z.jsonl", "start=20240102T000000Z_end=20240103T000000Z.jsonl"]
    (folder / names[0]).write_text('{"datetime": "2024-01-01T00:00:00Z", "value": 1}\n{"datetime": \n')
    (folder / names[1]).write_text('{"datetime": "2024-01-02T00:00:00Z", "value": 2}\n\n')
    schema = "datetime string, value double"
    assert landing.read_jsonl(spark, str(tmp_path), schema).count() == 2
    tree = landing.read_signal_tree(spark, str(tmp_path), schema, file_level=True).collect()
    assert [(r["value"], r["mode"], r["zone"], r["signal"], r["chunk_start"].day) for r in tree] == [(2.0, "backfill", "A", "total-load", 2)]
    assert landing.quarantine(spark, str(tmp_path), schema).count() == 1


def test_first_readable(spark, tmp_path):
    weather(spark).write.parquet(str(tmp_path / "b"))
    assert tables.first_readable(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).count() == 10
    with pytest.raises(FileNotFoundError):
        tables.first_readable(spark, [str(tmp_path / "a")])


def test_late_rows_are_counted(spark, tmp_path):
    counter = hourly.LateRowCounter()
    spark.streams.addListener(counter)
    landing_dir = tmp_path / "in"
    landing_dir.mkdir()

    def deliver(name, hours):
        lines = [json.dumps({"zone": "A", "signal": "s", "datetime": f"2024-01-01T{h:02d}:00:00Z", "value": 1.0}) for h in hours]
        (landing_dir / name).write_text("\n".join(lines))
        stream = hourly.parse_readings(hourly.read_landing_stream(spark, str(landing_dir), "zone string, signal string, datetime string, value double"))
        query = hourly.write_available(hourly.first_delivery(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        query.awaitTermination()

    try:
        deliver("a.json", [10, 11, 12])
        deliver("b.json", [1, 2, 13])
        assert spark.read.parquet(str(tmp_path / "out")).count() == 4
        for _ in range(50):
            if counter.dropped:
                break
            import time

            time.sleep(0.1)
        assert counter.dropped == 2
    finally:
        spark.streams.removeListener(counter)


def test_scratch_needs_a_shared_folder(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_latest_rows_limit_before_the_shuffle(spark):
    from tidemark.operators.series import latest_rows

    plan = latest_rows(forecast(spark), Series(), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_start_options_of_long_series_equal_those_of_short_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(z, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v)) for z in "AB" for i, v in enumerate(rng.integers(0, 50, 200))]
    df = spark.createDataFrame(rows, "zone string, datetime timestamp, predicted_carbon_intensity double")
    short, long = (schedule.start_options(df, Series(**kw), [1, 3]) for kw in ({"short_keys": True}, {"chunk_steps": 16}))
    assert sorted(short.collect()) == sorted(long.select(*short.columns).collect())


def test_many_latest_rows_are_cut_in_parts(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("zone"), F.timestamp_seconds(F.col("id") * 3600).alias("datetime"), "id")
    got = series.latest_rows(df, Series(), 1500)
    assert sorted(r["id"] for r in got.collect()) == list(range(6000, 9000))
    assert got._jdf.queryExecution().executedPlan().toString().count("Window") >= 2
