"""Labels, splits in time and naive forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import TARGET
from tidemark.operators.metrics import baseline_scores, long_predictions, scores
from tidemark.operators.series import Series, bounded_window
from tidemark.session import written

SPLITS = ("train", "val", "test")


def assign_split(df: DataFrame, train_end: str, val_end: str, time: str = "datetime") -> DataFrame:
    """Add ``split``: train up to ``train_end``, val up to ``val_end``, test after it."""
    ts = F.col(time)
    return df.withColumn(
        "split",
        F.when(ts <= F.lit(train_end).cast("timestamp"), "train")
        .when(ts <= F.lit(val_end).cast("timestamp"), "val")
        .when(ts.isNotNull(), "test"),
    )


def embargo(df: DataFrame, train_end: str, val_end: str, hours: int, time: str = "datetime") -> DataFrame:
    """Drop the last ``hours`` before each border, whose labels lie in the next split."""
    gap = F.make_dt_interval(F.lit(0), F.lit(hours))
    keep = F.lit(True)
    for border in (train_end, val_end):
        end = F.lit(border).cast("timestamp")
        keep = keep & ~((F.col(time) > end - gap) & (F.col(time) <= end))
    return df.filter(keep)


def drop_unlabelled(df: DataFrame, prefix: str = "carbon_intensity_target_") -> DataFrame:
    """Rows with every target present."""
    return df.dropna(subset=[c for c in df.columns if c.startswith(prefix)])


def split_overlap(df: DataFrame, keys: Sequence[str] = ("zone", "datetime")) -> DataFrame:
    """Keys that occur in more than one split."""
    per_key = df.groupBy(*keys).agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
    return per_key.filter(F.col("first_split") != F.col("last_split"))


def write_splits(df: DataFrame, path: str) -> None:
    """Parquet partitioned by split; readers of one split touch only its files."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(path)


def _with_previous(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Each row's ``value`` of the row before it in key order, one row per key.

    Keys are dealt to tasks by range; only one row per range is ordered in a single task.
    """
    ranged = written(df.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "key-ranges")
    ends = ranged.groupBy("_range").agg(F.max_by(F.struct(value), key).alias("_end"))
    before = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_before"))
    inside = F.lag(F.struct(value)).over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_own", inside).join(before, "_range").select(
        *df.columns, F.coalesce("_own", "_before")[value].alias(name)
    )


def with_series_baselines(df: DataFrame, series: Series = Series(), target: str = TARGET, across_zones: bool = False) -> DataFrame:
    """Add persistence (1 and 24 rows back) and hourly-mean forecasts of the current value.

    ``across_zones`` lets the one-row persistence run on from the end of one zone into
    the next, in zone order.
    """
    lagged = bounded_window(
        df,
        series,
        24,
        0,
        lambda w: {"pred_persistence_1h": F.lag(target, 1).over(w), "pred_persistence_24h": F.lag(target, 24).over(w)},
    )
    if across_zones:
        key = series.keys[0]
        edges = df.groupBy(key).agg(
            F.max_by(target, series.time).alias("_last"), F.min(series.time).alias("_first_time")
        )
        previous = _with_previous(edges, key, "_last", "_previous_last").drop("_last")
        lagged = (
            lagged.join(previous, key)
            .withColumn(
                "pred_persistence_1h",
                F.when(F.col(series.time) == F.col("_first_time"), F.col("_previous_last")).otherwise(
                    F.col("pred_persistence_1h")
                ),
            )
            .drop("_first_time", "_previous_last")
        )
    hourly = lagged.groupBy(F.hour(series.time).alias("_hour")).agg(F.avg(target).alias("pred_historical_mean"))
    # At most 24 rows.
    return lagged.withColumn("_hour", F.hour(series.time)).join(F.broadcast(hourly), "_hour", "left").drop("_hour")


def series_baseline_report(df: DataFrame, series: Series = Series(), target: str = TARGET, across_zones: bool = False) -> DataFrame:
    """Error of the three naive forecasts over the whole table."""
    wide = with_series_baselines(df, series, target, across_zones)
    names = {"pred_persistence_1h": "persistence_1h", "pred_persistence_24h": "persistence_24h", "pred_historical_mean": "historical_mean"}
    long = long_predictions(wide, target, names, "baseline")
    return baseline_scores(long, ["baseline"])


def zone_hour_means(train: DataFrame, target: str = TARGET, zone: str = "zone", time: str = "datetime") -> DataFrame:
    return train.groupBy(zone, F.hour(time).alias("hour_of_day")).agg(F.avg(target).alias("hist_mean"))


def with_zone_hour_mean(test: DataFrame, means: DataFrame, zone: str = "zone", time: str = "datetime") -> DataFrame:
    """Left join of the training means; the planner broadcasts them when small."""
    keyed = test if "hour_of_day" in test.columns else test.withColumn("hour_of_day", F.hour(time))
    return keyed.join(means, [zone, "hour_of_day"], "left")


def horizon_baselines(
    train: DataFrame,
    test: DataFrame,
    targets: Mapping[int, str],
    target: str = TARGET,
    lag_24h: str = f"{TARGET}_lag_24h",
) -> DataFrame:
    """Scores of current value, value a day ago and (zone, hour) mean, per horizon."""
    scored = with_zone_hour_mean(test, zone_hour_means(train, target))
    forecasts = {"naive_persistence": target, "lag24h_persistence": lag_24h, "historical_mean": "hist_mean"}
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("baseline_type"),
                F.lit(h).alias("horizon"),
                F.col(column).cast("double").alias("actual"),
                F.col(forecast).cast("double").alias("predicted"),
            )
            for name, forecast in forecasts.items()
            for h, column in targets.items()
        ]
    )
    return scores(scored.select(F.inline(pairs)), ["baseline_type", "horizon"])
