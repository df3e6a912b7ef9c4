"""Time-ordered folds with an embargo, and errors of model settings over them.

The span of the labelled rows is cut into equal parts. Fold i is tested on part i + 1 and learns from all rows whose
label was known when that part began, so nothing is learned from the time that is tested.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.model import FEATURES, TreeParams, input_stages
from tidemark.operators.series import floor_div
from tidemark.session import written

TRAIN, TEST = "train", "test"


def rolling_folds(df: DataFrame, time: str, folds: int, embargo_seconds: int) -> DataFrame:
    """Rows with ``fold`` (from 1) and ``role``, each once for every fold that it takes part in.

    With lo and hi the first and last time, test part i begins at lo + (hi - lo) * i / (folds + 1), the last
    one includes hi. A row trains fold i if its time plus the embargo is not after that beginning. All
    folds come from one pass over the table. Rows without a time take part in none.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = df.agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))

    def begin(i):
        return F.col("_lo") + floor_div((F.col("_hi") - F.col("_lo")) * i, folds + 1)

    fold = F.col("fold")
    tested = (at >= begin(fold)) & ((fold == folds) | (at < begin(fold + 1)))
    role = F.when(tested, TEST).when(at + embargo_seconds * 1_000_000 <= begin(fold), TRAIN)
    # One row of two numbers.
    spread = df.join(F.broadcast(span)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    return spread.withColumn("role", role).where(F.col("role").isNotNull()).drop("_lo", "_hi")


def rolling_errors(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    settings: Mapping[str, TreeParams],
    time: str,
    embargo_seconds: int,
    key: Sequence[str],
    folds: int = 3,
    fit_rows: int = 2000,
    weight: str | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """setting, folds, rows_scored, mean_actual, mae over the test parts of all folds.

    Every labelled row of a test part is scored by every setting. Trees are fitted on at most
    ``fit_rows`` training rows of a fold, the first by a hash of ``key``; medians come from all of them. Folds
    without training rows are left out. A table without any gives no rows.
    """
    table = written(rolling_folds(df.dropna(subset=[label]), time, folds, embargo_seconds), "folds")
    sizes = {r["fold"] for r in table.where(F.col("role") == TRAIN).select("fold").distinct().collect()}
    kept = [label, *([weight] if weight else [])]

    def scored(fold: int) -> DataFrame:
        part = table.where(F.col("fold") == fold)
        train = part.where(F.col("role") == TRAIN)
        inputs = Pipeline(stages=input_stages(train, features)).fit(train)
        first = train.orderBy(F.xxhash64(*key), *key).limit(fit_rows)
        sample = written(inputs.transform(first).select(FEATURES, *kept), "fold-sample")
        rows = inputs.transform(part.where(F.col("role") == TEST)).select(FEATURES, F.col(label).alias("_actual"))
        # All settings score in one scan.
        for i, params in enumerate(settings.values()):
            rows = params.regressor(label, weight).fit(sample).setPredictionCol(f"_p{i}").transform(rows)
        errors = [F.struct(F.lit(s).alias("setting"), F.abs(F.greatest(F.col(f"_p{i}"), F.lit(0.0)) - F.col("_actual")).alias("_error")) for i, s in enumerate(settings)]
        return rows.select(F.lit(fold).alias("fold"), F.col("_actual"), F.inline(F.array(*errors)))

    if not sizes:
        schema = "setting string, folds int, rows_scored bigint, mean_actual double, mae double"
        return df.sparkSession.createDataFrame([], schema)
    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(scored, sorted(sizes)))
    # Partial sums per fold and setting, a few rows.
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("setting")
        .agg(
            F.count_distinct("fold").cast("int").alias("folds"),
            F.count(F.lit(1)).alias("rows_scored"),
            F.avg("_actual").alias("mean_actual"),
            F.avg("_error").alias("mae"),
        )
    )


def one_at_a_time(base: TreeParams, values: Mapping[str, Sequence]) -> dict[str, TreeParams]:
    """``parameter=value`` to the base with that parameter changed."""
    return {f"{p}={v}": replace(base, **{p: v}) for p, options in values.items() for v in options}
