"""Correcting deliveries and distances between distributions."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import distance
from tidemark.sources import deliveries

SCHEMA = "zone string, datetime timestamp, value double, version int"
KEYS = ["zone", "datetime"]


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def merged(spark, path, rows):
    return deliveries.merge_delivery(spark.createDataFrame(rows, SCHEMA), path, KEYS, "datetime", "version")


def stored(spark, path):
    return {(r["zone"], r["datetime"]): (r["value"], r["version"]) for r in deliveries.read_deliveries(spark, path, SCHEMA).collect()}


def test_only_touched_partitions_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "table")
    assert stored(spark, path) == {}
    first = [(z, at(d, h), float(d * 100 + h), 1) for z in "AB" for d in (1, 2, 3) for h in range(24)]
    assert merged(spark, path, first) == 6
    before = files(path)
    # A correction of one hour, with an older version and a repeated row beside it, and rows that are not taken.
    fix = [("A", at(2, 5), -1.0, 3), ("A", at(2, 5), -2.0, 2), ("A", at(2, 5), -1.0, 3), ("B", at(3, 1), 7.0, 0), (None, at(1), 1.0, 9), ("A", None, 1.0, 9), ("A", at(1), 1.0, None)]
    assert merged(spark, path, fix) == 1
    after = files(path)
    gone = set(before) - set(after)
    assert gone and all("zone=A/delivery_day=2024-01-02" in f for f in gone ^ (set(after) - set(before)))
    assert all(before[f] == after[f] for f in set(before) & set(after))
    want = {(z, t): (v, n) for z, t, v, n in first} | {("A", at(2, 5)): (-1.0, 3)}
    assert stored(spark, path) == want
    # The same delivery again, a late older one, and an empty one change no file.
    for again in (fix, first, []):
        assert merged(spark, path, again) == 0 and files(path) == after
    # A new day and a new zone.
    assert merged(spark, path, [("A", at(9), 1.0, 1), ("C", at(1), None, 1)]) == 2
    assert stored(spark, path) == want | {("A", at(9)): (1.0, 1), ("C", at(1)): (None, 1)}


def test_order_of_deliveries_does_not_matter(spark, tmp_path):
    rng = random.Random(2)
    parts = [[("A", at(rng.randint(1, 3), rng.randint(0, 3)), float(rng.randint(0, 9)), rng.randint(1, 3)) for _ in range(25)] for _ in range(3)]
    for n, order in enumerate(((0, 1, 2), (2, 0, 1), (1, 1, 2, 0, 2))):
        for i in order:
            merged(spark, str(tmp_path / str(n)), parts[i])
    tables = [stored(spark, str(tmp_path / str(n))) for n in range(3)]
    best = {}
    for z, t, v, n in sum(parts, []):
        best[z, t] = max(best.get((z, t), (-1, -1)), (n, v))
    assert tables[0] == tables[1] == tables[2] == {k: (v, n) for k, (n, v) in best.items()}


def test_distances_equal_a_plain_version(spark):
    rng = np.random.default_rng(1)
    base = np.concatenate((rng.normal(0, 1, 700), np.repeat(0.25, 300), [0.0, -0.0]))
    now = np.concatenate((rng.normal(0.4, 1.3, 500), np.repeat(0.25, 10)))
    rows = [spark.createDataFrame([(float(v), None) for v in side] + [(None, 1.0), (float("nan"), None)], "x double, y double") for side in (base, now)]
    rows[0] = rows[0].withColumn("y", F.lit(None).cast("double"))
    grid = np.unique(np.concatenate((base, now)))
    gaps = np.abs(np.searchsorted(np.sort(base), grid, "right") / len(base) - np.searchsorted(np.sort(now), grid, "right") / len(now))
    for per_range in (100, 10**6):
        got = {r["feature"]: r for r in distance.distribution_distance(rows[1], rows[0], ["x", "y"], per_range).collect()}
        assert np.isclose(got["x"]["ks"], gaps.max()) and np.isclose(got["x"]["wasserstein"], (gaps[:-1] * np.diff(grid)).sum())
        assert (got["x"]["baseline_n"], got["x"]["current_n"]) == (len(base), len(now))
        assert (got["y"]["baseline_n"], got["y"]["ks"], got["y"]["wasserstein"]) == (0, None, None)
    same = distance.distribution_distance(rows[0], rows[0], ["x"], 50).first()
    assert (same["ks"], same["wasserstein"]) == (0.0, 0.0)
    assert distance.distribution_distance(rows[0].limit(0), rows[0].limit(0), ["x"]).count() == 0
