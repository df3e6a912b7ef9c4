"""Stored profiles: merged equals one pass, quantiles within the stated rank error."""

from __future__ import annotations

import random
import statistics

import pytest

from tidemark.operators import sketches

QUANTILES = {"p5": 0.05, "median": 0.5, "p99": 0.99}


def test_merged_profiles_against_all_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b"]), i % 30, rng.choice([None, float("nan"), rng.gauss(5, 3), float(rng.randrange(40))])) for i in range(30_000)]
    rows += [("c", 1, None), (None, 2, 4.0)]
    df = spark.createDataFrame(rows, "zone string, day int, x double")
    stored = sketches.sketch_table(df, ["zone", "day"], ["x"])
    merged = sketches.merge_sketches(sketches.merge_sketches(stored, ["zone", "day"]), ["zone"])
    for table in (merged, sketches.sketch_table(df, ["zone"], ["x"])):
        got = {r["zone"]: r for r in sketches.sketched_profile(table, ["zone"], QUANTILES).collect()}
        assert set(got) == {"a", "b", "c", None}
        for zone, r in got.items():
            every = [x for z, _, x in rows if z == zone]
            values = sorted(x for x in every if x is not None and x == x)
            assert (r["rows"], r["n"]) == (len(every), len(values)) and r["null_rate"] == pytest.approx(1 - len(values) / len(every))
            if not values:
                assert (r["mean"], r["median"], r["smallest"], r["distinct"]) == (None, None, None, 0)
                continue
            assert r["mean"] == pytest.approx(statistics.fmean(values)) and (r["smallest"], r["largest"]) == (values[0], values[-1])
            if len(values) > 1:
                assert r["std"] == pytest.approx(statistics.stdev(values))
            assert abs(r["distinct"] - len(set(values))) <= 0.06 * len(set(values))
            for name, q in QUANTILES.items():
                below, upto = (sum(f(x) for x in values) / len(values) for f in (lambda x: x < r[name], lambda x: x <= r[name]))
                assert below - 0.01 <= q <= upto + 0.01


def test_sketches_of_an_empty_table(spark):
    df = spark.createDataFrame([], "zone string, x double")
    assert sketches.sketch_table(df, ["zone"], ["x"]).count() == 0 and sketches.sketch_table(df, [], ["x"]).count() == 0
    assert sketches.merge_sketches(sketches.sketch_table(df, ["zone"], ["x"]), []).count() == 0
