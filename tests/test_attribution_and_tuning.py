"""Additive attribution against subsets of features, and Parzen search against a plain twin and random search."""

import itertools
import math
import random
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution, model, tuning


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(400).select(
        "id",
        F.when(i % 7 != 0, (i * 7919 % 101).cast("double")).alias("a"),
        (i * 104729 % 53).cast("double").alias("b"),
        (i % 3).cast("double").alias("c"),
        ((i * 7919 % 101) * 0.7 + (i * 104729 % 53) * (i % 3)).alias("y"),
        (1.0 + i % 2).alias("w"),
    )


@pytest.fixture(scope="module")
def fit(rows):
    params = model.TreeParams(trees=5, depth=3, step=0.3, subsample=1.0, columns=1.0, min_rows=3)
    return model.fit_horizon(rows, None, ["a", "b", "c"], "y", params, "w")


def expected(nodes, at, x, known):
    """Prediction of one tree when only the features in ``known`` may be asked."""
    node = nodes[at]
    if node["left"] < 0:
        return node["prediction"]
    if node["feature"] in known:
        return expected(nodes, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], x, known)
    return sum(nodes[c]["cover"] / node["cover"] * expected(nodes, c, x, known) for c in (node["left"], node["right"]))


def test_contributions_equal_all_subsets(spark, rows, fit):
    trees = {}
    for r in attribution._node_table(fit.stages[-1]).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    weights = list(fit.stages[-1].treeWeights)
    names, owner = attribution.feature_names(fit)
    got = attribution.attributions(fit, rows, ["id"]).orderBy("id").limit(40).collect()
    vectors = {r["id"]: r[model.FEATURES].toArray() for r in fit.transform(rows).where("id < 40").collect()}
    n = len(owner)
    for r in got:
        x, want = vectors[r["id"]], np.zeros(len(names))
        value = {s: sum(w * expected(trees[t], 0, x, s) for t, w in enumerate(weights)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for i in range(n):
            others = [j for j in range(n) if j != i]
            for k in range(n):
                for s in itertools.combinations(others, k):
                    want[owner[i]] += factorial(k) * factorial(n - k - 1) / factorial(n) * (value[tuple(sorted((*s, i)))] - value[s])
        assert np.allclose(r["contributions"], want) and math.isclose(r["base"], value[()])
    assert names == ["a", "b", "c"]


def test_base_and_contributions_are_the_prediction(rows, fit):
    got = attribution.attributions(fit, rows, ["id"])
    off = got.where(F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x) - F.col("raw")) > 1e-9)
    assert got.count() == 400 and off.count() == 0
    names, _ = attribution.feature_names(fit)
    top = attribution.top_attributions(got, names, 2).collect()
    means = np.abs(np.array([r["contributions"] for r in got.collect()])).mean(axis=0)
    assert [r["feature"] for r in top] == [names[i] for i in np.argsort(-means)[:2]]
    assert np.allclose([r["mean_abs"] for r in top], np.sort(means)[::-1][:2])
    assert attribution.attributions(fit, rows.limit(0), ["id"]).count() == 0
    assert attribution.top_attributions(got.limit(0), names).count() == 0


SPACE = {"x": (0.0, 1.0), "k": (1, 9)}


def plain_density(x, values, low, high):
    """The same mixture, written from its definition with one integral instead of the normal distribution function."""
    values = sorted(values)
    parts = [1 / (high - low)]
    for i, mean in enumerate(values):
        beside = [abs(mean - v) for v in values[max(0, i - 1) : i] + values[i + 1 : i + 2]] or [(high - low) / 2]
        width = max(*beside, (high - low) / min(100, len(values) + 2))
        grid = np.linspace(low, high, 20_001)
        bell = np.exp(-(((grid - mean) / width) ** 2) / 2)
        parts.append(math.exp(-(((x - mean) / width) ** 2) / 2) / np.trapezoid(bell, grid))
    return sum(parts) / len(parts)


def test_densities_and_proposals_equal_a_plain_twin():
    rng = random.Random(3)
    history = [(p, (p["x"] - 0.3) ** 2 + abs(p["k"] - 4)) for p in (tuning.random_point(SPACE, rng) for _ in range(13))]
    better = [p for p, _ in sorted(history, key=lambda h: h[1])[:2]]
    worse = [p for p, _ in sorted(history, key=lambda h: h[1])[2:]]
    got = tuning.propose(history, SPACE, random.Random(8))
    twin, want = random.Random(8), {}
    for name, (low, high) in (("x", (0.0, 1.0)), ("k", (0.5, 9.5))):
        good = tuning.Parzen([p[name] for p in better], low, high)
        for x in np.linspace(low, high, 7):
            assert math.isclose(good.density(x), plain_density(x, [p[name] for p in better], low, high), rel_tol=1e-4)
        drawn = [good.draw(twin) for _ in range(tuning.CANDIDATES)]
        ratio = [plain_density(x, [p[name] for p in better], low, high) / plain_density(x, [p[name] for p in worse], low, high) for x in drawn]
        want[name] = drawn[int(np.argmax(ratio))]
    assert got == {"x": round(want["x"], 4), "k": round(want["k"])}


def test_search_beats_random_points():
    space = {"x": (-5.0, 5.0), "y": (-5.0, 5.0), "k": (0, 20)}

    def error(p):
        return (p["x"] - 1.3) ** 2 + (p["y"] + 2.1) ** 2 + 0.3 * abs(p["k"] - 7)

    wins, found, plain = 0, [], []
    for seed in range(24):
        found.append(min(e for _, e in tuning.minimise(error, space, 40, 10, batch=2, seed=seed)))
        plain.append(min(e for _, e in tuning.minimise(error, space, 40, 40, seed=seed)))
        wins += found[-1] < plain[-1]
    assert wins >= 15 and np.mean(found) < 0.75 * np.mean(plain)


def test_trials_score_all_rows(rows):
    train, val = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    space = {"trees": (1, 3), "depth": (1, 3), "step": (0.1, 0.5)}
    got = tuning.tpe_search(train, val, ["a", "b", "c"], "y", space, trials=6, startup=3, batch=3, fit_on=train.limit(150), weight="w").collect()
    assert [r["trial"] for r in got] == list(range(6)) and {r["rows_scored"] for r in got} == {100}
    best = next(r for r in got if r["is_best"])
    assert best["mae"] == min(r["mae"] for r in got) and sum(r["is_best"] for r in got) == 1
    params = model.TreeParams(trees=int(best["trees"]), depth=int(best["depth"]), step=best["step"])
    fit_rows, tables = tuning.prepared(train.limit(150), train, ["a", "b", "c"], {"score": val})
    again = params.regressor("y", "w").fit(fit_rows).transform(tables["score"]).agg(F.avg(F.abs(F.col("y") - F.greatest("predicted", F.lit(0.0))))).first()[0]
    assert math.isclose(again, best["mae"], rel_tol=1e-9)
