"""Forecast scores, overall and per slice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import buckets, calendar, scalars

# Fixed value: keeps the percentage error finite at zero.
MAPE_EPSILON = 1e-8


def weather_classes() -> dict[str, Column]:
    """Named weather conditions; one row can be in several. Names and limits are fixed values."""
    temperature, wind, cloud = F.col("temperature_2m_c"), F.col("wind_speed_100m_ms"), F.col("cloud_cover_pct")
    return {
        "Cold (< 5C)": temperature < 5,
        "Mild (5-20C)": (temperature >= 5) & (temperature < 20),
        "Hot (>= 20C)": temperature >= 20,
        "Windy (>= 10 m/s)": wind >= 10,
        "Calm (< 10 m/s)": wind < 10,
        "Overcast (>= 75%)": cloud >= 75,
        "Clear (< 25%)": cloud < 25,
    }


def long_predictions(wide: DataFrame, actual: str, forecasts: Mapping[str, str], label: str) -> DataFrame:
    """One row per forecast column: (label, actual, predicted)."""
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias(label),
                        F.col(actual).cast("double").alias("actual"),
                        F.col(column).cast("double").alias("predicted"),
                    )
                    for column, name in forecasts.items()
                ]
            )
        )
    )


def score_columns(actual: str = "actual", predicted: str = "predicted", digits: int = 4) -> list[Column]:
    """MAE, RMSE, R² and MAPE as aggregates over rows that have both values."""
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    y, p = F.when(both, F.col(actual)), F.when(both, F.col(predicted))
    error = y - p
    spread = F.var_pop(y) * F.count(y)
    return [
        scalars.half_even(F.avg(F.abs(error)), digits).alias("mae"),
        scalars.half_even(F.sqrt(F.avg(error * error)), digits).alias("rmse"),
        scalars.half_even(1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0)), digits).alias("r2"),
        scalars.half_even(F.avg(F.abs(error / (y + MAPE_EPSILON))) * 100, digits).alias("mape"),
    ]


def scores(df: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Scores per group; mergeable aggregates only, so a hot group is pre-reduced per task."""
    return df.groupBy(*by).agg(*score_columns(digits=digits))


def baseline_scores(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """MAE, RMSE and MAPE without an epsilon; rows with a zero actual leave the MAPE."""
    both = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    error = F.when(both, F.col("actual") - F.col("predicted"))
    return df.groupBy(*by).agg(
        scalars.half_even(F.avg(F.abs(error)), 2).alias("mae"),
        scalars.half_even(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
        scalars.half_even(F.avg(F.abs(error / F.nullif(F.col("actual"), F.lit(0.0)))) * 100, 2).alias("mape"),
    )


def with_errors(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Predicted value, error and absolute error, to two digits."""
    error = scalars.half_even(scalars.half_even(F.col(predicted), 2) - F.col(actual), 2)
    return df.withColumns({"error": error, "abs_error": F.abs(error)})


def forecast_curve_scores(df: DataFrame, by: Sequence[str] = ("horizon_hours",)) -> DataFrame:
    """MAE and R² per horizon straight from the prediction table."""
    y, e = F.col("actual"), F.col("actual") - F.col("predicted")
    return with_errors(df).groupBy(*by).agg(
        F.avg("abs_error").alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
    )


def slice_members(zone: str = "zone", time: str = "datetime", bucket_of: str = "actual") -> Column:
    """All (slice_type, slice_value) pairs of a row; null entries are no member."""

    def pair(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("slice_type"), value.cast("string").alias("slice_value")))

    members = [
        pair("overall", F.lit("all")),
        pair("zone", F.col(zone)),
        pair("season", calendar.season_name(F.col(time))),
        pair("carbon_bucket", buckets.level_with_range(F.col(bucket_of))),
    ]
    members += [pair("weather_condition", F.when(test, F.lit(name))) for name, test in weather_classes().items()]
    return F.array_compact(F.array(*members))


def slice_scores(
    df: DataFrame,
    by: Sequence[str] = ("model", "horizon_hours"),
    min_rows: int = 10,
    bucket_of: str = "actual",
) -> DataFrame:
    """Scores of every slice from one scan; slices under ``min_rows`` are left out."""
    sliced = df.select(*by, "actual", "predicted", F.inline(slice_members(bucket_of=bucket_of)))
    return (
        sliced.groupBy(*by, "slice_type", "slice_value")
        .agg(F.count(F.lit(1)).alias("n_samples"), *score_columns())
        .filter(F.col("n_samples") >= min_rows)
    )


def disparities(slices: DataFrame, by: Sequence[str] = ("model", "horizon_hours"), threshold: float = 0.20) -> DataFrame:
    """Each slice's MAE against the overall MAE of its group."""
    # The slice table is the small result of one scan; a window keeps it at one scan.
    base = F.max(F.when(F.col("slice_type") == "overall", F.col("mae"))).over(Window.partitionBy(*by))
    relative = F.coalesce((F.col("mae") - F.col("_base")) / F.nullif(F.col("_base"), F.lit(0.0)), F.lit(0.0))
    return (
        slices.withColumn("_base", base)
        .filter((F.col("slice_type") != "overall") & F.col("_base").isNotNull())
        .select(
            *by,
            "slice_type",
            "slice_value",
            "n_samples",
            F.col("mae").alias("slice_mae"),
            scalars.half_even(F.col("_base"), 4).alias("baseline_mae"),
            scalars.half_even(relative, 4).alias("relative_diff"),
            scalars.signed_percent(relative).alias("pct_deviation"),
            (F.abs(relative) > threshold).alias("flagged"),
        )
    )


def critical_count(reports: DataFrame, threshold: float = 80.0, text: str = "pct_deviation") -> DataFrame:
    """How many deviations exceed the threshold; text that is no percentage is skipped."""
    value = F.abs(scalars.parse_percent(F.col(text)))
    return reports.agg(F.count_if(F.coalesce(value > threshold, F.lit(False))).alias("critical"))


def slice_summary(slices: DataFrame, disparity: DataFrame, by: Sequence[str] = ("model", "horizon_hours")) -> DataFrame:
    """Overall scores, worst zone, worst bucket and number of flagged slices per group."""

    def pick(kind: str, column: str) -> Column:
        return F.when(F.col("slice_type") == kind, F.col(column))

    def worst(kind: str) -> Column:
        # Largest error, first name on ties.
        return F.min_by("slice_value", F.when(F.col("slice_type") == kind, F.struct(-F.col("mae"), F.col("slice_value"))))

    summary = slices.groupBy(*by).agg(
        F.max(pick("overall", "mae")).alias("overall_mae"),
        F.max(pick("overall", "rmse")).alias("overall_rmse"),
        F.max(pick("overall", "r2")).alias("overall_r2"),
        worst("zone").alias("worst_zone"),
        F.max(pick("zone", "mae")).alias("worst_zone_mae"),
        worst("carbon_bucket").alias("worst_carbon_bucket"),
        F.max(pick("carbon_bucket", "mae")).alias("worst_carbon_bucket_mae"),
        F.count_if(F.col("slice_type") == "overall").alias("_overall"),
    )
    flags = disparity.groupBy(*by).agg(F.count_if("flagged").alias("n_flagged_slices"))
    return (
        summary.filter(F.col("_overall") > 0)
        .drop("_overall")
        .join(flags, list(by), "left")
        .fillna({"n_flagged_slices": 0})
    )


def findings(disparity: DataFrame, mitigation: DataFrame, zone: str) -> DataFrame:
    """The key numbers of a slice audit in one row."""
    flagged = F.col("flagged")

    def worst(kind: str, by: Column, column: str) -> Column:
        return F.max_by(column, F.when(flagged & (F.col("slice_type") == kind), F.struct(by, F.col("slice_value"), F.col("pct_deviation"))))

    size = F.abs(F.col("relative_diff"))
    numbers = disparity.agg(
        worst("zone", size, "slice_value").alias("worst_zone"),
        worst("zone", size, "pct_deviation").alias("worst_zone_deviation"),
        worst("carbon_bucket", F.col("relative_diff"), "slice_value").alias("worst_bucket"),
        worst("carbon_bucket", F.col("relative_diff"), "pct_deviation").alias("worst_bucket_deviation"),
        F.count_if(flagged & (F.col("slice_type") == "weather_condition")).alias("flagged_weather"),
    ).withColumn("_one", F.lit(1))
    gain = mitigation.agg(
        F.avg(F.when(F.col("slice_value") == zone, F.col("mae_improvement_pct"))).alias("mean_improvement_pct")
    ).withColumn("_one", F.lit(1))
    return numbers.join(F.broadcast(gain), "_one").drop("_one")


def rare_slice_check(df: DataFrame, by: Sequence[str], limit: float = 100.0, level_of: str = "actual") -> DataFrame:
    """Error on rows below ``limit`` against the error on all rows."""
    error, rare = F.abs(F.col("actual") - F.col("predicted")), F.col(level_of) < limit
    return (
        df.groupBy(*by)
        .agg(
            F.count_if(rare).alias("rare_rows"),
            F.avg(F.when(rare, error)).alias("rare_mae"),
            F.avg(error).alias("overall_mae"),
        )
        .withColumn("deviation_pct", (F.col("rare_mae") - F.col("overall_mae")) / F.nullif(F.col("overall_mae"), F.lit(0.0)) * 100)
    )


def bucket_confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of actual level against predicted level; levels are 0 to 4.

    Every group has a row for each of the five actual levels, with zeros where none was seen;
    without ``by`` that holds for an empty table too.
    """
    classes = list(range(len(buckets.LEVELS)))
    seen = df.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull()).select(
        *by, buckets.level_index(F.col("actual")).alias("actual_level"), buckets.level_index(F.col("predicted")).alias("p")
    )
    # One pass: each group's 25 cells as five structs, then a row per struct.
    cells = [
        F.struct(
            F.lit(a).alias("actual_level"),
            *[F.count_if((F.col("actual_level") == a) & (F.col("p") == c)).alias(f"predicted_{c}") for c in classes],
        )
        for a in classes
    ]
    return seen.groupBy(*by).agg(F.array(*cells).alias("_rows")).select(*by, F.inline("_rows"))


def residual_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    residual = F.col("actual") - F.col("predicted")
    return df.groupBy(*by).agg(
        F.avg(residual).alias("mean_residual"),
        F.stddev_pop(residual).alias("std_residual"),
        F.avg(F.abs(residual)).alias("mae"),
        F.min(residual).alias("min_residual"),
        F.max(residual).alias("max_residual"),
    )


def residual_histogram(df: DataFrame, by: Sequence[str], bins: int = 60) -> DataFrame:
    """Equal-width counts between the smallest and largest residual; empty bins included."""
    by = list(by)
    with_residual = df.select(*by, (F.col("actual") - F.col("predicted")).alias("_r")).filter(F.col("_r").isNotNull())
    edges = with_residual.groupBy(*by).agg(F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.least(F.floor((F.col("_r") - F.col("_lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    counted = (
        with_residual.join(edges, by)
        .groupBy(*by, F.coalesce(index, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = edges.select(
        *by,
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        "_lo",
        width.alias("_width"),
    )
    return frame.join(counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_start"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def best_per_group(df: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str]) -> DataFrame:
    """The row with the smallest metric per group."""
    rest = [c for c in df.columns if c not in by]
    best = F.min_by(F.struct(*rest), F.when(F.col(metric).isNotNull(), F.struct(metric, *ties)))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def comparison_table(baselines: DataFrame, models: DataFrame) -> DataFrame:
    """Best baseline of each horizon next to every model's scores."""
    columns = ["mae", "rmse", "r2", "mape"]
    best = best_per_group(baselines.select("horizon", "baseline_type", *columns), ["horizon"], "mae", ["baseline_type"])
    top = best.select(
        "horizon",
        F.format_string("Best Baseline (%dh)", F.col("horizon")).alias("model"),
        F.lit("baseline").alias("model_type"),
        *columns,
    )
    rest = models.select(
        "horizon", F.format_string("%s (%dh)", F.col("model_type"), F.col("horizon")).alias("model"), "model_type", *columns
    )
    return top.unionByName(rest)


def select_best_models(comparison: DataFrame) -> DataFrame:
    """Best trained model of each horizon."""
    trained = comparison.filter(F.col("model_type") != "baseline")
    return best_per_group(trained, ["horizon"], "mae", ["model"])


def align_predictions(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str] = ("zone",), time: str = "datetime") -> DataFrame:
    """Actual value at ``time + horizon`` next to each prediction made at ``time``."""
    due = predictions.withColumn("_due", F.col(time) + F.make_dt_interval(F.lit(0), F.col("horizon_hours")))
    seen = actuals.select(*keys, F.col(time).alias("_due"), F.col("actual"))
    return due.join(seen, [*keys, "_due"], "left").drop("_due")

