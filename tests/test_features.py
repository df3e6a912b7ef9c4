"""Lags, rolling statistics, feature profiles, labels and splits."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar, scalars
from tidemark.operators import features, rolling, series, split
from tidemark.operators.series import Series

START = dt.datetime(2024, 1, 1)
COLUMNS = [
    features.TARGET,
    features.LOAD,
    features.TEMPERATURE,
    features.WIND,
    features.CLOUD,
    features.RADIATION,
    features.CARBON_FREE,
    features.RENEWABLE,
]


def table(spark, lengths, seed=3):
    rng = random.Random(seed)
    rows = [
        (z, START + dt.timedelta(hours=i), *[float(rng.randint(0, 90)) for _ in COLUMNS])
        for z, n in lengths.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "zone string, datetime timestamp, " + ", ".join(f"{c} double" for c in COLUMNS))


def rows_of(df, columns):
    return [tuple(r) for r in df.orderBy("zone", "datetime").select(*columns).collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=1e-7) if None not in (*x, *y) else [v is None for v in x] == [v is None for v in y]


def test_lag_exact(spark):
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), 10.0 * (i + 1)) for i in range(5)], "zone string, datetime timestamp, v double")
    assert rows_of(features.add_lag_features(df, Series(), ["v"], [1]), ["v_lag_1h"]) == [(None,), (10,), (20,), (30,), (40,)]


def test_rolling_mean_exact(spark):
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), 10.0 * (i + 1)) for i in range(5)], "zone string, datetime timestamp, v double")
    got = rows_of(features.add_rolling_features(df, Series(), {"v": {3: ("mean",)}}), ["v_mean_3h"])
    assert [r[0] for r in got] == pytest.approx([10, 15, 20, 30, 40])


def test_chunks_equal_plain_windows(spark):
    df = table(spark, {"A": 700, "B": 31, "C": 1}).withColumn(
        features.TARGET, F.when(F.col(features.TARGET) > 20, F.col(features.TARGET))
    )
    rolled = {features.TARGET: {n: ("mean", "std", "min", "max", "count") for n in (4, 5, 12, 24, 97)}}
    w = Window.partitionBy("zone").orderBy("datetime")
    plain = df.select(
        "zone",
        "datetime",
        *[
            F.expr(f"{rolling.STATISTICS[s]}({features.TARGET})").over(w.rowsBetween(-(n - 1), 0)).alias(features.rolling_name(features.TARGET, s, n))
            for n, stats in rolled[features.TARGET].items()
            for s in stats
        ],
        F.lag(features.TARGET, 168).over(w).alias("l"),
    )
    made = features.add_rolling_features(df, Series(chunk_steps=30), rolled)
    names = [c for c in plain.columns if c not in ("zone", "datetime", "l")]
    close(rows_of(made, names), rows_of(plain, names))
    lagged = features.add_lag_features(df, Series(chunk_steps=30), [features.TARGET], [168])
    assert rows_of(lagged, [f"{features.TARGET}_lag_168h"]) == rows_of(plain, ["l"])


def test_equal_values_have_no_spread(spark):
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), 0.1 if i else 1e9) for i in range(40)], "zone string, datetime timestamp, v double")
    got = rows_of(features.add_rolling_features(df, Series(), {"v": {12: ("std",)}}), ["v_std_12h"])
    assert got[-1] == (0.0,)


@pytest.mark.parametrize("profile", ["train", "serve"])
def test_one_pass_fill_of_complete_columns_equals_general_fill(spark, profile):
    df = table(spark, {"A": 400, "B": 168, "C": 169, "D": 2, "E": 1})
    complete = features.build_features(df, profile=profile, fill="complete")
    general = features.build_features(df, profile=profile)
    names = [c for c in features.numeric_columns(complete)]
    close(rows_of(complete, names), rows_of(general, names))


def test_default_fill_takes_the_next_value_over_raw_nulls(spark):
    df = table(spark, {"A": 30}).withColumn(features.TARGET, F.when(F.hour("datetime") > 1, F.lit(2.0)))
    got = [r[0] for r in rows_of(features.build_features(df), [f"{features.TARGET}_lag_1h"])]
    assert got[:4] == [2.0, 2.0, 2.0, 2.0]


@pytest.mark.parametrize("rows", [4, 12, 17, 24])
def test_deviation_after_a_large_step(spark, rows):
    values = [1.0, 2.0, *[1e9 + i for i in range(60)]]
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "zone string, datetime timestamp, v double")
    got = rows_of(features.add_rolling_features(df, Series(), {"v": {rows: ("std",)}}), [f"v_std_{rows}h"])
    assert got[-1][0] == pytest.approx((rows * (rows + 1) / 12) ** 0.5, rel=1e-9)


def test_train_profile_has_all_columns(spark):
    out = features.build_features(table(spark, {"A": 30}))
    made = set(out.columns) - {"zone", "datetime", *COLUMNS}
    assert len(made) == 11 + 6 + 20 + 36 + 5
    nulls = out.select([F.count_if(F.col(c).isNull()).alias(c) for c in features.numeric_columns(out)]).first()
    assert sum(nulls) == 0


def test_causal_fill_never_looks_ahead(spark):
    out = features.build_features(table(spark, {"A": 30}), fill="causal")
    first = out.orderBy("datetime").first()
    assert first[f"{features.TARGET}_lag_1h"] == 0 and first[f"{features.TARGET}_std_4h"] == 0


def test_solar_potential(spark):
    df = table(spark, {"A": 13}).withColumn(features.CLOUD, F.lit(50.0))
    noon = features.build_features(df).orderBy(F.desc("datetime")).first()
    assert noon["solar_potential"] == 0.5


@pytest.mark.parametrize("month,season", [(12, "Winter"), (2, "Winter"), (3, "Spring"), (5, "Spring"), (6, "Summer"), (8, "Summer"), (9, "Fall"), (11, "Fall")])
def test_seasons(spark, month, season):
    ts = F.lit(f"2024-{month:02d}-15").cast("timestamp")
    assert spark.range(1).select(calendar.season_name(ts)).first()[0] == season


def test_skew_report(spark):
    df = table(spark, {"A": 3})
    report = features.profile_skew(features.build_features(df), features.build_features(df, profile="serve"))
    got = {r["feature"]: r["status"] for r in report.collect()}
    assert got["season"] == "type differs" and got["lag_1h"] == "serve only" and got["quarter"] == "train only"


def test_splits_cover_every_row_once(spark):
    df = table(spark, {"A": 100, "B": 50})
    out = split.assign_split(df, "2024-01-02 00:00:00", "2024-01-03 00:00:00")
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(counts.values()) == 150 and counts["train"] == 50
    assert split.split_overlap(out).count() == 0


def test_rounding_ignores_float_noise(spark):
    got = spark.range(1).select(
        scalars.half_even(F.lit(0.1) + F.lit(0.2) + F.lit(0.0500000000000001 - 0.05) + 0.045, 2),
        scalars.half_even(F.lit(2.5), 0),
        scalars.half_even(F.lit(3.5), 0),
    ).first()
    assert tuple(got) == (0.34, 2.0, 4.0)


def test_islands_cross_chunks(spark):
    flags = [0, 1, 1, 1, 0, 0, 1, 0, 1, 1]
    df = spark.createDataFrame([("A", START + dt.timedelta(hours=i), bool(f)) for i, f in enumerate(flags)], "zone string, datetime timestamp, f boolean")
    out = series.islands(df, Series(chunk_steps=2), F.col("f"))
    spans = out.filter("_island is not null").groupBy("_island").count().orderBy("_island").collect()
    assert [(r["_island"].hour, r["count"]) for r in spans] == [(1, 3), (6, 1), (8, 2)]
