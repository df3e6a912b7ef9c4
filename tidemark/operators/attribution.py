"""Additive attribution of tree-ensemble predictions: Shapley values over tree paths.

A row's contributions and the base add up to its prediction. The expectation that a missing coalition
member leaves is the one the trees themselves hold: at a split on a feature outside the coalition both
branches count, by the training weight that went each way. A leaf then contributes to the features on its path
only, and what it contributes depends on which of their conditions the row meets: one small vector per leaf
and set of met conditions, looked up for whole batches of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.model import FEATURES, MISSING, VALUE
from tidemark.session import scratch_path


@dataclass(frozen=True)
class Leaf:
    """A leaf's value (times its tree's weight) and, per feature on its path, the interval (low, high] and the
    share of training weight that meets the feature's splits."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]

    def contributions(self, met: tuple[bool, ...]) -> list[float]:
        """Shapley value of every feature on the path, for a row that meets these conditions.

        A coalition with an unmet member leaves nothing of the leaf, so only coalitions of met features
        count; ``sums[k]`` adds, over those of k features, the shares of all features outside.
        """
        m, out = len(self.features), []
        for i in range(m):
            sums = [1.0] + [0.0] * (m - 1)
            for j in range(m):
                if j != i:
                    inside = [0.0, *sums[:-1]] if met[j] else [0.0] * m
                    sums = [self.share[j] * s + x for s, x in zip(sums, inside)]
            weighted = sum(s * factorial(k) * factorial(m - k - 1) / factorial(m) for k, s in enumerate(sums))
            out.append(self.value * (float(met[i]) - self.share[i]) * weighted)
        return out


@dataclass(frozen=True)
class Paths:
    """All leaves of an ensemble, and its expected prediction."""

    leaves: tuple[Leaf, ...]
    size: int

    @property
    def base(self) -> float:
        return sum(leaf.value * prod(leaf.share) for leaf in self.leaves)


def leaves_of(nodes: Mapping[int, Mapping], weight: float) -> list[Leaf]:
    """Leaves of one tree from its nodes: id, left, right, feature, threshold, cover, prediction."""
    found = []
    open_: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
    while open_:
        at, path = open_.pop()
        node = nodes[at]
        if node["left"] < 0:
            order = sorted(path)
            low, high, share = (tuple(path[f][k] for f in order) for k in range(3))
            found.append(Leaf(node["prediction"] * weight, tuple(order), low, high, share))
            continue
        low, high, share = path.get(node["feature"], (-np.inf, np.inf, 1.0))
        for child, interval in ((node["left"], (low, min(high, node["threshold"]))), (node["right"], (max(low, node["threshold"]), high))):
            part = nodes[child]["cover"] / node["cover"]
            open_.append((child, {**path, node["feature"]: (*interval, share * part)}))
    return found


def ensemble_paths(model: PipelineModel) -> Paths:
    """The leaves of a fitted ensemble, from the node table that it is saved as.

    The table has as many rows as the trees have nodes, which the model's own parameters bound.
    """
    trees = model.stages[-1]
    weights = list(trees.treeWeights)
    by_tree: dict[int, dict[int, dict]] = {}
    for r in _node_table(trees).collect():
        if r["categories"] >= 0:
            raise ValueError("splits on categories are not supported")
        by_tree.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    found = [leaf for tree in sorted(by_tree) for leaf in leaves_of(by_tree[tree], weights[tree])]
    return Paths(tuple(found), trees.numFeatures)


def _node_table(trees) -> DataFrame:
    spark = SparkSession.active()
    path = scratch_path(spark, "ensemble")
    trees.write().save(path)
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return node.select(
        F.col("treeID").alias("tree"),
        "id",
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0)).alias("threshold"),
        F.col("split.numCategories").alias("categories"),
        # The training weight in the node is the first of its statistics.
        F.get("impurityStats", F.lit(0)).alias("cover"),
        "prediction",
    )


def attribute_batch(paths: Paths, x: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Contributions of ``owners`` features to each row of ``x``; ``owner`` says which one a column belongs to."""
    out = np.zeros((len(x), owners))
    for leaf in paths.leaves:
        at = list(leaf.features)
        if not at:
            continue
        met = (x[:, at] > np.array(leaf.low)) & (x[:, at] <= np.array(leaf.high))
        code = met @ (1 << np.arange(len(at)))
        codes, place = np.unique(code, return_inverse=True)
        table = np.array([leaf.contributions(tuple(bool(c >> k & 1) for k in range(len(at)))) for c in codes.tolist()])
        for k, feature in enumerate(at):
            out[:, owner[feature]] += table[place, k]
    return out


def feature_names(model: PipelineModel) -> tuple[list[str], np.ndarray]:
    """The features, and which of them each column of the model's vector belongs to."""
    columns = [c.removeprefix(VALUE).removeprefix(MISSING) for c in model.stages[-2].getInputCols()]
    names = list(dict.fromkeys(columns))
    return names, np.array([names.index(c) for c in columns])


def attributions(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, raw (the prediction before any floor), base, and contributions in the order of ``feature_names``.

    A feature's value and its missing mark count together. base and contributions add up to raw on every
    row. Rows with missing features are explained like others; an empty table gives no rows.
    """
    names, owner = feature_names(model)
    paths = ensemble_paths(model)
    shared = df.sparkSession.sparkContext.broadcast(paths)

    @F.pandas_udf("array<double>")
    def explained(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list(attribute_batch(shared.value, np.stack(column.to_list()), owner, len(names))))

    scored = model.transform(df).withColumn("_x", vector_to_array(FEATURES))
    return scored.select(*keep, F.col("predicted").alias("raw"), F.lit(paths.base).alias("base"), explained("_x").alias("contributions"))


def top_attributions(attributed: DataFrame, names: Sequence[str], top: int = 10) -> DataFrame:
    """feature, mean_abs: the features with the largest mean absolute contribution over all rows."""
    means = attributed.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"_{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{i}").alias("mean_abs")) for i, n in enumerate(names)])
    return means.select(F.inline(rows)).where("mean_abs is not null").orderBy(F.desc("mean_abs"), "feature").limit(top)
