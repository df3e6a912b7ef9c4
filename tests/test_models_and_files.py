"""Models on rows with missing features, CSV header forms, the confusion matrix, live rows and open domains."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, model, quality
from tidemark.sources import landing
from tidemark.streaming import live


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.range(60).select(
        "id",
        F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("a"),
        F.when(F.col("id") % 5 != 0, F.lit(float("nan"))).otherwise(1.0).alias("b"),
        F.lit(None).cast("double").alias("empty"),
        (F.col("id") * 2.0).alias("y"),
    )
    return table


def test_every_row_is_fitted_predicted_and_measured(spark, rows, tmp_path):
    params = model.TreeParams(trees=2, depth=2, subsample=1.0, columns=1.0, min_rows=1)
    fit = model.fit_horizon(rows, None, ["a", "b", "empty"], "y", params)
    model.save_models({1: fit}, str(tmp_path))
    loaded = model.load_models([1], [f"{tmp_path}/none", str(tmp_path)])[1]
    got = model.predict(loaded, rows)
    assert got.count() == 60 and got.filter(F.col("predicted").isNull()).count() == 0
    assert got.columns == [*rows.columns, "predicted"]
    assert sorted(got.select("id", "predicted").collect()) == sorted(model.predict(fit, rows).select("id", "predicted").collect())
    assert {r["feature"] for r in model.importances(fit).collect()} == {"a", "b", "empty"}
    assert model.permutation_importance(fit, rows, ["a", "b", "empty"], "y", ["id"]).count() == 3
    with pytest.raises(FileNotFoundError):
        model.load_models([1, 2], [str(tmp_path)])


def test_csv_in_any_header_form(spark, tmp_path):
    files = {
        "a.csv": "time,rain\n1,2\n1,2\n",
        "b.csv": "rain,time\r\n3,4\r\n",
        "c.csv": '﻿"time","snow, fresh","rain"\n"5","a ""b"", c",\n',
        "d.csv": "time,rain\ntime,rain\n6,7\n",
        "e.csv": "when,rain\n8,9\n",
        "f.csv": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    got = landing.read_csv_folder(spark, str(tmp_path))
    assert sorted((r["time"], r["rain"], r["snow, fresh"]) for r in got.collect()) == sorted(
        [("1", "2", None), ("1", "2", None), ("4", "3", None), ("5", None, 'a "b", c'), ("time", "rain", None), ("6", "7", None)], key=lambda r: r[0]
    )
    assert [r["header"] for r in landing.csv_quarantine(spark, str(tmp_path)).collect()] == ["when,rain"]


def test_confusion_has_all_levels(spark):
    one = spark.createDataFrame([(600.0, 50.0)], "actual double, predicted double")
    table = {r["actual_level"]: [r[f"predicted_{i}"] for i in range(5)] for r in metrics.bucket_confusion(one).collect()}
    assert sorted(table) == [0, 1, 2, 3, 4] and table[4] == [1, 0, 0, 0, 0] and table[0] == [0] * 5


def test_domains_are_closed_unless_declared_open(spark):
    stored = spark.range(1500).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("t"))
    baseline = quality.infer_baseline(stored, open_columns=["t"])
    fresh = spark.createDataFrame([("1", "y"), ("none", "x")], "k string, t string")
    found = quality.schema_anomalies(fresh, baseline, quality.baseline_columns(baseline))
    assert [(r["column"], r["detail"]) for r in found.collect()] == [("k", "none")]


def test_late_hours_see_their_whole_history():
    hours = {h: float(h) for h in range(300) if h != 255}
    before = live.feature_rows(hours, [256])
    kept = {h: v for h, v in hours.items() if h > 299 - live.HISTORY_HOURS} | {255: 255.0}
    after = live.feature_rows(kept, [255, 256, 299])
    assert before.loc[256, "lag_168h"] == after.loc[256, "lag_168h"] == 88.0
    assert after.loc[256, "lag_1h"] == 255.0 and after.loc[299, "lag_24h"] == 275.0


def test_newest_row_wins(spark):
    columns = {f.name: None for f in live.OUTPUT.fields}
    at = dt.datetime(2024, 1, 1)
    data = [(*({**columns, "zone": "A", "datetime": at, "status": s, "value": v}.values()), b) for s, v, b in [("row", 1.0, 0), ("row", 2.0, 3), ("late", 9.0, 4)]]
    schema = live.OUTPUT.simpleString()[7:-1].replace(":", " ") + ", batch int"
    assert [r["value"] for r in live.newest_rows(spark.createDataFrame(data, schema)).collect()] == [2.0]


def test_csv_file_read_by_many_tasks(spark, tmp_path):
    """One file cut into many blocks loses no line, repeats none and reads no header as a row."""
    rows = [f'{i},"a ""{i}"" , b",{i * 3}' for i in range(20000)]
    (tmp_path / "large.csv").write_text("\n\n" + "time,note,rain\n" + "\n".join(rows) + "\n")
    (tmp_path / "small.csv").write_text("rain,time\n-1,20000")
    (tmp_path / "long.csv").write_text("time,note\n20001,\"" + "x," * 50000 + "\"\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = landing.read_csv_folder(spark, str(tmp_path))
        assert landing._csv_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        found = sorted((int(r["time"]), r["note"], r["rain"]) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == [*[(i, f'a "{i}" , b', str(i * 3)) for i in range(20000)], (20000, None, "-1"), (20001, "x," * 50000, None)]
