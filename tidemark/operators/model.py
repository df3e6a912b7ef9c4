"""Boosted-tree forecasts on feature tables with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators.metrics import scores, with_errors
from tidemark.operators.resample import with_class_index

FEATURES = "_features"
VALUE, MISSING = "_value_", "_missing_"


@dataclass(frozen=True)
class TreeParams:
    trees: int = 500
    depth: int = 6
    step: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    min_rows: int = 5
    seed: int = 42

    def regressor(self, label: str, weight: str | None = None, validation: str | None = None) -> GBTRegressor:
        model = GBTRegressor(
            featuresCol=FEATURES,
            labelCol=label,
            predictionCol="predicted",
            maxIter=self.trees,
            maxDepth=self.depth,
            stepSize=self.step,
            subsamplingRate=self.subsample,
            featureSubsetStrategy=str(self.columns),
            minInstancesPerNode=self.min_rows,
            seed=self.seed,
        )
        if weight:
            model = model.setWeightCol(weight)
        return model.setValidationIndicatorCol(validation) if validation else model


def fit_horizon(
    train: DataFrame,
    validation: DataFrame | None,
    features: Sequence[str],
    label: str,
    params: TreeParams = TreeParams(),
    weight: str | None = None,
) -> PipelineModel:
    """Weighted fit; trees stop growing when the validation error no longer falls."""
    data = train.withColumn("_validation", F.lit(False))
    if validation is not None:
        data = data.unionByName(validation.withColumn("_validation", F.lit(True)))
    data = data.dropna(subset=[label])
    stages = [*input_stages(train, features), params.regressor(label, weight, "_validation" if validation is not None else None)]
    return Pipeline(stages=stages).fit(data)


def input_stages(train: DataFrame, features: Sequence[str]) -> list:
    """Stages from feature columns to the vector, for any pattern of nulls and NaN.

    A missing value takes the median of the training rows (0 where a feature has none), and every
    feature brings a column that tells where it was missing. No row is dropped, in fitting or
    in prediction.
    """
    number = {f: f"nullif(CAST(`{f}` AS DOUBLE), CAST('NaN' AS DOUBLE))" for f in features}
    medians = train.agg(*[F.expr(f"percentile_approx({e}, 0.5)").alias(f"m{i}") for i, e in enumerate(number.values())]).first()
    values = [f"coalesce({e}, {float(medians[i] or 0.0)!r}D) AS `{VALUE}{f}`" for i, (f, e) in enumerate(number.items())]
    missing = [f"CAST({e} IS NULL AS DOUBLE) AS `{MISSING}{f}`" for f, e in number.items()]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join([*values, *missing])} FROM __THIS__"),
        VectorAssembler(inputCols=[p + f for p in (VALUE, MISSING) for f in features], outputCol=FEATURES, handleInvalid="error"),
    ]


def predict(model: PipelineModel, df: DataFrame, floor: float = 0.0) -> DataFrame:
    """Add ``predicted``, not below the floor. Every row gets one."""
    scored = model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns if c != "predicted"], "predicted")
    return scored.withColumn("predicted", scalars.floor_at(F.col("predicted"), floor))


def predict_horizons(models: Mapping[int, PipelineModel], df: DataFrame, keep: Sequence[str], targets: Mapping[int, str] | None = None, name: str = "gbt") -> DataFrame:
    """One row per (row, horizon), from a single scan of the table."""
    scored = df
    for horizon, model in models.items():
        scored = predict(model, scored).withColumnRenamed("predicted", f"_p{horizon}")
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_hours"),
                F.lit(name).alias("model"),
                (F.col(targets[h]) if targets else F.lit(None)).cast("double").alias("actual"),
                F.col(f"_p{h}").alias("predicted"),
            )
            for h in models
        ]
    )
    return scored.select(*keep, F.inline(rows))


def prediction_table(models: Mapping[int, PipelineModel], df: DataFrame, targets: Mapping[int, str]) -> DataFrame:
    return with_errors(predict_horizons(models, df, ["zone", "datetime"], targets))


def save_models(models: Mapping[int, PipelineModel], path: str) -> None:
    """One folder per horizon."""
    for horizon, model in models.items():
        model.write().overwrite().save(f"{path}/horizon={horizon}")


def load_models(horizons: Sequence[int], paths: Sequence[str]) -> dict[int, PipelineModel]:
    """The fitted model of each horizon from the first of ``paths`` that has it."""
    found: dict[int, PipelineModel] = {}
    for horizon in horizons:
        places = [f"{p}/horizon={horizon}" for p in paths]
        place = next((p for p in places if _exists(p)), None)
        if place is None:
            raise FileNotFoundError(f"no model for horizon {horizon} in {list(paths)}")
        found[horizon] = PipelineModel.load(place)
    return found


def _exists(path: str) -> bool:
    spark = SparkSession.active()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def split_scores(model: PipelineModel, splits: Mapping[str, DataFrame], label: str) -> DataFrame:
    table: DataFrame | None = None
    for name, df in splits.items():
        part = predict(model, df).select(F.lit(name).alias("split"), F.col(label).cast("double").alias("actual"), "predicted")
        table = part if table is None else table.unionByName(part)
    return scores(table, ["split"])


def importances(model: PipelineModel) -> DataFrame:
    """Feature importances, largest first. One row per feature, its missing mark included."""
    total: dict[str, float] = {}
    for column, value in zip(model.stages[-2].getInputCols(), model.stages[-1].featureImportances.toArray()):
        feature = column.removeprefix(VALUE).removeprefix(MISSING)
        total[feature] = total.get(feature, 0.0) + float(value)
    rows = list(total.items())
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def random_search(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    label: str,
    trials: int = 20,
    space: Mapping[str, tuple] | None = None,
    weight: str | None = None,
    seed: int = 42,
) -> tuple[TreeParams, list[tuple[TreeParams, float]]]:
    """Seeded random search by validation error. Trial results are a few numbers each."""
    # The search space.
    space = space or {
        "trees": (200, 1500),
        "depth": (3, 10),
        "step": (0.01, 0.3),
        "subsample": (0.5, 1.0),
        "columns": (0.5, 1.0),
        "min_rows": (1, 20),
    }
    rng = random.Random(seed)
    history = []
    for _ in range(trials):
        drawn = {k: rng.randint(a, b) if isinstance(a, int) else round(rng.uniform(a, b), 4) for k, (a, b) in space.items()}
        params = TreeParams(**drawn, seed=seed)
        model = fit_horizon(train, validation, features, label, params, weight)
        scored = predict(model, validation.dropna(subset=[label]))
        mae = scored.agg(F.avg(F.abs(F.col(label) - F.col("predicted"))).alias("mae")).first()["mae"]
        history.append((params, mae))
    return min(history, key=lambda h: h[1])[0], history


def sensitivity(df: DataFrame, features: Sequence[str], label: str, base: TreeParams, values: Mapping[str, Sequence], folds: int = 3, parallelism: int = 2) -> DataFrame:
    """Cross-validated error when one parameter at a time takes other values."""
    labelled = df.dropna(subset=[label])
    assembled = Pipeline(stages=input_stages(labelled, features)).fit(labelled).transform(labelled)
    regressor = base.regressor(label)
    names = {"trees": regressor.maxIter, "depth": regressor.maxDepth, "step": regressor.stepSize}
    maps = [(p, v, {names[p]: v}) for p, options in values.items() for v in options]
    evaluator = RegressionEvaluator(labelCol=label, predictionCol="predicted", metricName="mae")
    validator = CrossValidator(
        estimator=regressor,
        estimatorParamMaps=[m for _, _, m in maps],
        evaluator=evaluator,
        numFolds=folds,
        parallelism=parallelism,
        seed=base.seed,
    )
    means = validator.fit(assembled.select(FEATURES, label)).avgMetrics
    rows = [(p, float(v), float(m)) for (p, v, _), m in zip(maps, means)]
    return df.sparkSession.createDataFrame(rows, "parameter string, value double, mae double")


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str]) -> DataFrame:
    """How much the error grows when one feature's values are dealt to other rows.

    Rows get a dense index in hashed order without one task seeing them all, and each row
    is paired with the next one by a join on the index.
    """
    clean = df.dropna(subset=[label]).withColumn("_all", F.lit(0))
    indexed = with_class_index(clean, "_all", key)
    dealer = indexed.select(
        F.pmod(F.col("_at") + 1, F.col("_size")).alias("_at"), *[F.col(f).alias(f"_s_{f}") for f in features]
    )
    dealt = indexed.join(dealer, "_at")
    # One scan: each row once as it is (no name) and once per permuted feature.
    repeated = dealt.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in ["", *features]])))
    table = repeated.select(
        label, "feature", *[F.when(F.col("feature") == f, F.col(f"_s_{f}")).otherwise(F.col(f)).alias(f) for f in features]
    )
    error = F.avg(F.abs(F.col(label) - F.col("predicted")))
    measured = predict(model, table).groupBy("feature").agg(error.alias("mae"))
    base = measured.filter(F.col("feature") == "").select(F.col("mae").alias("_base"), F.lit(1).alias("_one"))
    return (
        measured.filter(F.col("feature") != "")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(base), "_one")
        .select("feature", (F.col("mae") - F.col("_base")).alias("mae_increase"))
        .orderBy(F.desc("mae_increase"), "feature")
    )
