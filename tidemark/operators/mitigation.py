"""A mitigation run: balance the training rows, fit again, compare both versions on the same test rows.

The balanced rows go through a table, and so do the predictions of both versions: fitting reads its rows once per tree
level, and the report and the verdict must speak about the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import buckets
from tidemark.operators import decisions, metrics, model, resample
from tidemark.session import written

BEFORE, AFTER = "before", "after"
LEVEL, WEIGHT = "_level", "_weight"

# The rare level, the rows it is brought to and the weight of the favoured zone.
RARE_LEVEL = "Very Low (0-100)"
RARE_ROWS = 300
ZONE_FACTOR = 3.0


def balanced_rows(
    train: DataFrame,
    level_of: str,
    noisy: Sequence[str],
    zone: str,
    favoured: str,
    key: Sequence[str] = ("zone", "datetime"),
    rows: int = RARE_ROWS,
    factor: float = ZONE_FACTOR,
) -> DataFrame:
    """All training rows, noisy copies that bring the rare level to ``rows``, and their sample weight ``_weight``.

    Rows of the ``favoured`` zone weigh ``factor``, all others and every copy 1. Copies are marked
    ``is_synthetic``; a level that has enough rows or none at all gets no copy. ``train`` is read three
    times and should be a stored table; ``key`` must identify a row.
    """
    levelled = train.withColumn(LEVEL, buckets.level_with_range(F.col(level_of)))
    made = resample.oversample_with_noise(levelled, LEVEL, RARE_LEVEL, rows, key, noisy).drop(LEVEL)
    weight = buckets.zone_weight(F.col(zone), favoured, factor, F.col("is_synthetic"))
    return made.withColumn(WEIGHT, F.coalesce(weight, F.lit(1.0)))


def refit(
    balanced: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    label: str,
    params: model.TreeParams = model.TreeParams(),
    fit_rows: int | None = None,
) -> PipelineModel:
    """A model of the balanced rows. Each validation row weighs 1.

    ``fit_rows`` bounds the rows to fit on, and the validation rows that stop the trees, to those with the smallest
    hashes; a copy has its own hash, as its noise is its own.
    """
    columns = [*features, label]

    def labelled(df: DataFrame) -> DataFrame:
        df = df.select(*columns, WEIGHT).dropna(subset=[label])
        return df.orderBy(F.xxhash64(*columns), *columns).limit(fit_rows) if fit_rows else df

    rows = written(labelled(balanced), "balanced")
    watched = written(labelled(validation.withColumn(WEIGHT, F.lit(1.0))), "watched")
    return model.fit_horizon(rows, watched, features, label, params, WEIGHT)


def paired_predictions(current: PipelineModel, new: PipelineModel, test: DataFrame, keep: Sequence[str], label: str, horizon: int) -> DataFrame:
    """Each labelled test row once per version (``model`` is before or after), stored; from one scan of ``test``."""
    scored = model.predict(current, test.dropna(subset=[label])).withColumnRenamed("predicted", BEFORE)
    scored = model.predict(new, scored).withColumnRenamed("predicted", AFTER)
    rows = [
        F.struct(F.lit(horizon).alias("horizon_hours"), F.lit(v).alias("model"), F.col(label).cast("double").alias("actual"), F.col(v).alias("predicted"))
        for v in (BEFORE, AFTER)
    ]
    return written(scored.select(*keep, F.inline(F.array(*rows))), "versions")


def _versions(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scores of both versions, from a stored table of one row per group."""
    stored = written(scored, "scores")
    return tuple(stored.filter(F.col("model") == v).drop("model") for v in (BEFORE, AFTER))


def mitigation_report(predictions: DataFrame, min_rows: int = 10) -> DataFrame:
    """Every slice's error before and after, with its gain and its number of test rows."""
    by = ["horizon_hours", "slice_type", "slice_value"]
    before, after = _versions(metrics.slice_scores(predictions, min_rows=min_rows))
    return decisions.compare_slices(before, after, by).join(before.select(*by, "n_samples"), by, "left")


def retrained_verdicts(predictions: DataFrame) -> DataFrame:
    """improved, neutral or regressed per horizon, by the scores of both versions on the same rows."""
    current, new = _versions(metrics.scores(predictions, ["horizon_hours", "model"]))
    return decisions.promotion_verdicts(new, current, ["horizon_hours"])
