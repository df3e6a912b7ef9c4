"""Overlapping spans and rolling folds against plain loops."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, overlap
from tidemark.operators.model import TreeParams

T0 = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def spans(rng, n, longest):
    rows = []
    for i in range(n):
        a = rng.randrange(-3000, 6000)
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), a, a + rng.choice([0, 1, 60, rng.randrange(longest), -5])))
    return [*rows, (n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "a", 0, 400_000)]


@pytest.mark.parametrize("bin_seconds", [600, 3600, overlap.DAY, 10**9])
def test_overlaps_by_comparing_all_pairs(spark, bin_seconds):
    rng = random.Random(1)
    left, right = spans(rng, 40, 2000), spans(rng, 50, 300)
    left.append(left[3])
    l = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in left], "l int, zone string, a timestamp, b timestamp")
    r = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in right], "r int, zone string, c timestamp, d timestamp")
    want, totals = Counter(), Counter()
    for i, k, a, b in left:
        totals[i] += 0
        for j, m, c, d in right:
            if None not in (k, a, b, c, d) and k == m and a < b and c < d and max(a, c) < min(b, d):
                want[i, j, 60.0 * (min(b, d) - max(a, c))] += 1
                totals[i] += 60 * (min(b, d) - max(a, c))
    got = overlap.overlaps(l, r, ["zone"], ("a", "b"), ("c", "d"), bin_seconds)
    assert Counter((x["l"], x["r"], x["overlap_seconds"]) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    sums = overlap.overlap_totals(l, r, ["zone"], ["l"], ("a", "b"), ("c", "d"), bin_seconds).collect()
    assert {x["l"]: x["overlap_seconds"] for x in sums} == dict(totals)
    assert sum(x["overlapping"] for x in sums) == sum(want.values())


def test_overlaps_of_empty_tables_and_clashing_columns(spark):
    l = spark.createDataFrame([], "l int, zone string, a timestamp, b timestamp")
    r = spark.createDataFrame([(1, "a", T0, T0 + timedelta(1))], "r int, zone string, c timestamp, d timestamp")
    assert overlap.overlaps(l, r, ["zone"], ("a", "b"), ("c", "d")).count() == 0
    with pytest.raises(ValueError, match="'a'"):
        overlap.overlaps(l, r.withColumn("a", F.lit(1)), ["zone"], ("a", "b"), ("c", "d"))


@pytest.mark.parametrize("count, embargo", [(1, 0), (3, 12), (4, 40)])
def test_folds_by_one_loop(spark, count, embargo):
    rng = random.Random(count)
    hours = [rng.randrange(300) for _ in range(120)] + [0, 300, 75, 150]
    df = spark.createDataFrame([(i, at(60 * h)) for i, h in enumerate(hours)] + [(999, None)], "i int, datetime timestamp")
    got = Counter((r["i"], r["fold"], r["role"]) for r in folds.rolling_folds(df, "datetime", count, embargo * 3600).collect())
    want = Counter()
    for i, h in enumerate(hours):
        for f in range(1, count + 1):
            start, stop = 300 * f / (count + 1), 300 * (f + 1) / (count + 1)
            if start <= h and (h < stop or f == count):
                want[i, f, "test"] += 1
            elif h + embargo <= start:
                want[i, f, "train"] += 1
    assert got == want
    assert folds.rolling_folds(df.limit(0), "datetime", count, embargo).count() == 0


def test_rolling_errors_cover_all_test_rows(spark):
    rows = [(i, at(60 * i), float(i % 24), None if i % 50 == 7 else 10.0 * (i % 24) + 5) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, datetime timestamp, hour double, y double")
    settings = folds.one_at_a_time(TreeParams(trees=3, depth=4, step=0.5, subsample=1.0, columns=1.0), {"depth": (1, 4)})
    got = {r["setting"]: r for r in folds.rolling_errors(df, ["hour"], "y", settings, "datetime", 6 * 3600, ["i"]).collect()}
    known = [(at_, y) for _, at_, _, y in rows if y is not None]
    border = T0 + (known[-1][0] - T0) / 4
    tested = [y for when, y in known if when >= border]
    assert set(got) == {"depth=1", "depth=4"}
    for r in got.values():
        assert (r["folds"], r["rows_scored"]) == (3, len(tested)) and r["mean_actual"] == pytest.approx(sum(tested) / len(tested))
    assert 0 <= got["depth=4"]["mae"] < got["depth=1"]["mae"] < 100
    assert folds.rolling_errors(df.limit(0), ["hour"], "y", settings, "datetime", 0, ["i"]).count() == 0
