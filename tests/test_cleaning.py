"""Axis, fill, dedupe, clip, windows of dates, joins."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clean, features, series
from tidemark.operators.series import Series

START = dt.datetime(2024, 1, 1)


def hourly(spark, values, zone="A", skip=()):
    rows = [(zone, START + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "zone string, datetime timestamp, value double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("zone", "datetime").collect()]


def test_keep_first_removes_repeats(spark):
    df = hourly(spark, range(10)).unionByName(hourly(spark, [100, 200]))
    out = clean.keep_first(df, ["zone", "datetime"], ["value"])
    assert values(out) == [float(i) for i in range(10)]


def test_keep_first_keeps_a_missing_first_value(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, 5.0)], "zone string, position int, value double")
    assert clean.keep_first(df, ["zone"], ["position"]).first()["value"] is None


def test_axis_is_gap_free_and_keeps_values(spark):
    gaps = set(range(5, 100, 10))
    df = hourly(spark, range(100), skip=gaps)
    out = series.regularise(df, Series(chunk_steps=7))
    got = values(out)
    assert len(got) == 100
    assert [v for i, v in enumerate(got) if i not in gaps] == [float(i) for i in range(100) if i not in gaps]
    assert all(got[i] is None for i in gaps)


def test_axis_starts_at_the_first_time_of_the_key(spark):
    off = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1, 0, 30), 1.0), ("A", dt.datetime(2024, 1, 1, 3, 30), 2.0), ("A", dt.datetime(2024, 1, 1, 2, 0), 9.0)],
        "zone string, datetime timestamp, value double",
    )
    out = series.regularise(off, Series()).orderBy("datetime").collect()
    assert [r["datetime"].minute for r in out] == [30, 30, 30, 30]
    assert [r["value"] for r in out] == [1.0, None, None, 2.0]


def test_fill_exact(spark):
    assert values(series.fill_nulls(hourly(spark, [1.0, None, None, 4.0, 5.0]), Series(), ["value"])) == [1, 1, 1, 4, 5]
    assert values(series.fill_nulls(hourly(spark, [None, None, 3.0, None]), Series(), ["value"])) == [3, 3, 3, 3]


@pytest.mark.parametrize("directions", [("forward", "backward"), ("backward", "forward"), ("forward",)])
def test_fill_equals_a_plain_window(spark, directions):
    rows = []
    for z, n in (("A", 400), ("B", 90), ("C", 3)):
        for i in range(n):
            keep = (i * 7919 + len(z)) % 37 == 0 and not 100 < i < 300
            rows.append((z, START + dt.timedelta(hours=i), float(i) if keep else None))
    df = spark.createDataFrame(rows, "zone string, datetime timestamp, value double")
    w = Window.partitionBy("zone").orderBy("datetime")
    back = F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("value", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    pick = {"forward": back, "backward": ahead}
    expected = values(df.withColumn("value", F.coalesce("value", *[pick[d] for d in directions])))
    assert values(series.fill_nulls(df, Series(chunk_steps=16), ["value"], directions)) == expected
    kept = df.filter(F.col("value").isNotNull() | (F.col("datetime") == F.lit(START)) | (F.col("zone") == "C"))
    both = series.regularise_and_fill(kept, Series(chunk_steps=16), ["value"], directions)
    plain = series.fill_nulls(series.regularise(kept, Series()), Series(chunk_steps=16), ["value"], directions)
    assert values(both) == values(plain)


def test_fill_twice_changes_nothing(spark):
    once = series.fill_nulls(hourly(spark, [None, 2.0, None, None, 7.0]), Series(chunk_steps=2), ["value"])
    assert values(series.fill_nulls(once, Series(chunk_steps=2), ["value"])) == values(once)


def test_clip_leaves_missing_alone(spark):
    out = clean.clip_columns(hourly(spark, [50, 100, 150, 200, 250, None]), {"value": (75, 225)})
    assert values(out) == [75, 100, 150, 200, 225, None]


def test_date_window_is_inclusive(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i),) for i in range(365)]
    df = spark.createDataFrame(rows, "datetime timestamp")
    assert clean.training_window(df, "2024-02-01", "2024-02-29").count() == 29


def test_pivot_equals_outer_joins(spark):
    long = spark.createDataFrame(
        [("A", 1, "x", 1.0, 0), ("A", 1, "x", 9.0, 1), ("A", 2, "y", 2.0, 0), ("B", 1, "x", None, 0), ("B", 1, "x", 4.0, 1)],
        "zone string, datetime int, signal string, value double, position int",
    )
    got = clean.pivot_signals(long, {"x": "x", "y": "y"}, ["position"]).orderBy("zone", "datetime").collect()
    assert [tuple(r) for r in got] == [("A", 1, 1.0, None), ("A", 2, None, 2.0), ("B", 1, None, None)]


def test_missing_required_column(spark):
    with pytest.raises(ValueError):
        clean.select_and_rename(hourly(spark, [1]), {"value": "v"}, required=["time"])


def test_missing_value_field_gives_no_rows(spark):
    out = clean.project_signal(hourly(spark, [1]), "carbon", {"carbon": "absent"})
    assert out.count() == 0 and out.columns == ["zone", "datetime", "carbon"]


def test_union_fills_missing_columns(spark):
    out = clean.union_by_name([hourly(spark, [1]), hourly(spark, [2]).drop("value")])
    assert sorted(values(out), key=str) == [1.0, None]


def test_times_before_1970(spark):
    df = spark.range(1).select(series.floor_div(F.lit(-1).cast("long"), 10).alias("a"), series.floor_div(F.lit(-10).cast("long"), 10).alias("b"))
    assert tuple(df.first()) == (-1, -1)


def test_positions_and_slices(spark):
    df = hourly(spark, range(50), skip={3, 4, 20})
    s = Series(chunk_steps=8)
    got = series.with_position(df, s).orderBy("datetime").collect()
    assert [r["_position"] for r in got] == list(range(47))
    assert values(series.latest_rows(df, s, 3)) == [47, 48, 49]
    assert values(series.middle_rows(df, s, 4)) == [r["value"] for r in got[23:27]]


def test_zone_mapping_default(spark):
    dim = spark.createDataFrame([("A", "east")], "zone string, aws_region string")
    df = hourly(spark, [1]).unionByName(hourly(spark, [1], zone="B"))
    got = {r["zone"]: r["aws_region"] for r in clean.map_zone(df, dim, ["aws_region"]).collect()}
    assert got == {"A": "east", "B": "unknown"}


def test_align_columns(spark):
    out = features.align_columns(hourly(spark, [1]), ["value", "absent", "zone"])
    assert out.columns == ["value", "absent", "zone"] and tuple(out.first()) == (1.0, 0, 0)
