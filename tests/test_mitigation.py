"""The mitigation run against plain counts and scores."""

from pyspark.sql import functions as F
import pytest

from tidemark.operators import mitigation, model

PARAMS = model.TreeParams(trees=3, depth=3, step=0.3, subsample=1.0, columns=1.0, min_rows=3)


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(600).select(
        F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").alias("zone"),
        F.timestamp_seconds(i * 3600).alias("datetime"),
        F.when(i % 50 == 0, 40.0).otherwise(200.0 + i % 40).alias("level"),
        (i * 7919 % 101).cast("double").alias("x"),
        F.when(i % 11 != 0, (i % 7).cast("double")).alias("temperature_2m_c"),
        F.lit(3.0).alias("wind_speed_100m_ms"),
        F.lit(50.0).alias("cloud_cover_pct"),
        F.when(i % 13 != 0, 150.0 + (i * 7919 % 101) * 2 + i % 3).alias("y"),
    )


def test_rare_rows_are_copied_and_weighed(rows):
    made = mitigation.balanced_rows(rows, "level", ["x"], "zone", "a", ["datetime"], rows=100).toPandas()
    copies = made[made.is_synthetic]
    assert (len(made), len(copies)) == (600 + 88, 88)
    assert set(copies.level) == {40.0} and set(copies._weight) == {1.0}
    originals = made[~made.is_synthetic]
    assert set(originals[originals.zone == "a"]._weight) == {3.0} and set(originals[originals.zone != "a"]._weight) == {1.0}
    # A copy is near a rare row, and no two copies are alike.
    rare = originals[originals.level == 40.0].set_index("datetime").x
    assert (copies.x - copies.datetime.map(rare)).abs().max() < 0.01 * 6 * rare.std() and copies.x.nunique() == 88


def test_enough_or_no_rare_rows_give_no_copy(rows):
    assert mitigation.balanced_rows(rows, "level", ["x"], "zone", "a", ["datetime"], rows=12).filter("is_synthetic").count() == 0
    assert mitigation.balanced_rows(rows.where("level > 100"), "level", ["x"], "zone", "a", ["datetime"]).filter("is_synthetic").count() == 0
    assert mitigation.balanced_rows(rows.limit(0), "level", ["x"], "zone", "a", ["datetime"]).count() == 0


def test_both_versions_meet_the_same_rows(spark, rows):
    train, test = rows.where("hour(datetime) < 16"), rows.where("hour(datetime) >= 16")
    inputs = ["x", "temperature_2m_c", "level"]
    current = model.fit_horizon(train, test, inputs, "y", PARAMS)
    balanced = mitigation.balanced_rows(train, "level", ["x"], "zone", "a", ["datetime"], rows=60)
    new = mitigation.refit(balanced, test, inputs, "y", PARAMS, fit_rows=500)
    keep = ["zone", "datetime", "temperature_2m_c", "wind_speed_100m_ms", "cloud_cover_pct"]
    found = mitigation.paired_predictions(current, new, test, keep, "y", 12)
    plain = found.toPandas()
    assert len(plain) == 2 * test.where("y is not null").count()
    error = (plain.actual - plain.predicted).abs()
    mae = {(m, z): round(error[(plain.model == m) & (plain.zone == z)].mean(), 4) for m in ("before", "after") for z in ("a", "b")}
    report = {(r.slice_type, r.slice_value): r for r in mitigation.mitigation_report(found).collect()}
    for z in ("a", "b"):
        r = report["zone", z]
        assert (r.mae_before, r.mae_after) == pytest.approx((mae["before", z], mae["after", z]), abs=2e-4)
        assert r.mae_improvement == pytest.approx(r.mae_before - r.mae_after)
        assert r.n_samples == int(((plain.model == "before") & (plain.zone == z)).sum())
    overall = {m: error[plain.model == m].mean() for m in ("before", "after")}
    verdict = mitigation.retrained_verdicts(found).collect()
    assert len(verdict) == 1 and verdict[0].horizon_hours == 12
    share = (overall["after"] - overall["before"]) / overall["before"]
    if share > 0.0101:
        assert verdict[0].verdict == "regressed"
    # The same version on both sides changes nothing.
    same = mitigation.retrained_verdicts(mitigation.paired_predictions(current, current, test, keep, "y", 12)).collect()
    assert same[0].verdict == "neutral"
