"""Hyperparameter search by tree-structured Parzen estimators, trials of a batch run concurrently.

Finished trials are parted by error into a better and a worse share. Each share gives a density per parameter: a
mixture of normals around its values, cut at the parameter's range, and a flat part. Candidates are drawn from the better
density; the one whose ratio of better to worse density is largest is proposed next.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators.model import FEATURES, TreeParams, input_stages
from tidemark.session import written

Point = dict[str, float]
Space = Mapping[str, tuple]
BETTER = 0.1
CANDIDATES = 24


class Parzen:
    """Density of one parameter in [low, high] from the values of some trials."""

    def __init__(self, values: Sequence[float], low: float, high: float):
        self.values, self.low, self.high = sorted(values), low, high
        # A value's width reaches to its farther neighbour; a lone value's over half the range.
        gaps = [b - a for a, b in zip(self.values, self.values[1:])]
        sides = zip([0.0, *gaps], [*gaps, 0.0]) if gaps else [((high - low) / 2, 0.0)] * len(self.values)
        least = (high - low) / min(100.0, len(values) + 2.0)
        self.widths = [max(*side, least) for side in sides]

    def density(self, x: float) -> float:
        total = 1.0 / (self.high - self.low)
        for mean, width in zip(self.values, self.widths):
            inside = _normal((self.high - mean) / width) - _normal((self.low - mean) / width)
            total += math.exp(-(((x - mean) / width) ** 2) / 2) / (width * math.sqrt(2 * math.pi) * inside)
        return total / (len(self.values) + 1)

    def draw(self, rng: random.Random) -> float:
        k = rng.randrange(len(self.values) + 1)
        if k == len(self.values):
            return rng.uniform(self.low, self.high)
        while True:
            x = rng.gauss(self.values[k], self.widths[k])
            if self.low <= x <= self.high:
                return x


def _normal(z: float) -> float:
    return (1 + math.erf(z / math.sqrt(2))) / 2


def rounded(x: float, span: tuple) -> float:
    """A value as its parameter takes it: whole where the range is whole."""
    return int(min(max(round(x), span[0]), span[1])) if isinstance(span[0], int) else round(x, 4)


def random_point(space: Space, rng: random.Random) -> Point:
    return {k: rng.randint(a, b) if isinstance(a, int) else round(rng.uniform(a, b), 4) for k, (a, b) in space.items()}


def propose(history: Sequence[tuple[Point, float]], space: Space, rng: random.Random) -> Point:
    """The next point from finished trials (point, error); each parameter on its own."""
    ranked = sorted(history, key=lambda h: h[1])
    cut = max(1, math.ceil(BETTER * len(ranked)))
    point = {}
    for name, span in space.items():
        low, high = (float(span[0]) - 0.5, float(span[1]) + 0.5) if isinstance(span[0], int) else map(float, span)
        better, worse = (Parzen([p[name] for p, _ in part], low, high) for part in (ranked[:cut], ranked[cut:]))
        drawn = [better.draw(rng) for _ in range(CANDIDATES)]
        point[name] = rounded(max(drawn, key=lambda x: better.density(x) / worse.density(x)), span)
    return point


def minimise(objective: Callable[[Point], float], space: Space, trials: int, startup: int, batch: int = 1, seed: int = 42) -> list[tuple[Point, float]]:
    """All trials (point, error) in order: ``startup`` random ones, then proposals, ``batch`` at a time.

    Points of a batch are proposed from the trials before it and run concurrently.
    """
    rng = random.Random(seed)
    history: list[tuple[Point, float]] = []
    with ThreadPoolExecutor(max_workers=batch) as pool:
        while len(history) < trials:
            n = min(batch, trials - len(history))
            points = [random_point(space, rng) if len(history) + k < startup else propose(history, space, rng) for k in range(n)]
            history += zip(points, pool.map(objective, points))
    return history


def prepared(fit_on: DataFrame, medians_of: DataFrame, features: Sequence[str], others: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Vectors of ``fit_on`` and of other tables, written once; missing values take medians of ``medians_of``."""
    inputs = Pipeline(stages=input_stages(medians_of, features)).fit(fit_on)
    chosen = [c for c in fit_on.columns if c not in set(features)]

    def vectors(df: DataFrame, label: str) -> DataFrame:
        return written(inputs.transform(df).select(*chosen, FEATURES), label)

    return vectors(fit_on, "fit-vectors"), {k: vectors(df, "score-vectors") for k, df in others.items()}


def tpe_search(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    label: str,
    space: Space,
    trials: int = 20,
    startup: int = 8,
    batch: int = 4,
    fit_on: DataFrame | None = None,
    weight: str | None = None,
    seed: int = 42,
) -> DataFrame:
    """One row per trial: trial, its parameters, mae, rows_scored, mean_actual; the best has is_best.

    Every trial is fitted on the labelled rows of ``fit_on`` (all of ``train`` if not given) and scored on all labelled rows of
    ``validation``; medians come from all of ``train``. Trials of a batch share the cluster. Of equal errors the first is best.
    """
    fit_rows, tables = prepared((train if fit_on is None else fit_on).dropna(subset=[label]), train, features, {"score": validation.dropna(subset=[label])})
    found: dict[tuple, tuple[int, float]] = {}

    def error(point: Point) -> float:
        model = TreeParams(**point, seed=seed).regressor(label, weight).fit(fit_rows)
        scored = model.transform(tables["score"]).withColumn("predicted", scalars.floor_at(F.col("predicted"), 0.0))
        r = scored.agg(F.avg(F.abs(F.col(label) - F.col("predicted"))).alias("mae"), F.count(label).alias("n"), F.avg(label).alias("mean")).first()
        found[tuple(sorted(point.items()))] = (r["n"], r["mean"])
        return r["mae"] if r["n"] else math.inf

    history = minimise(error, space, trials, startup, batch, seed)
    best = min(range(len(history)), key=lambda i: history[i][1])
    rows = [
        (i, *[float(p[k]) for k in space], float(mae), *found[tuple(sorted(p.items()))], i == best)
        for i, (p, mae) in enumerate(history)
    ]
    schema = f"trial int, {', '.join(f'{k} double' for k in space)}, mae double, rows_scored long, mean_actual double, is_best boolean"
    return train.sparkSession.createDataFrame(rows, schema)
