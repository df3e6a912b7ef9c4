"""Low-value windows of a forecast and start times for batches of jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators.ranks import quantile_columns
from tidemark.operators.series import CHUNK, POSITION, Series, bounded_window, floor_div, islands, with_position
from tidemark.session import written

PREDICTED = "predicted_carbon_intensity"
# The recommendation texts.
WAIT_TEXT = "Wait %d hours — start at %s. Save %.1f kg CO₂ (%.1f%% reduction)."
NOW_TEXT = "Run now — this is already the optimal window."


def mark_green(
    df: DataFrame,
    series: Series,
    percentile: float = 25.0,
    fixed: float | None = None,
    value: str = PREDICTED,
) -> DataFrame:
    """Add the forecast's threshold and whether each hour is at or below it.

    The threshold is ``fixed`` or the linear-interpolated percentile of the key. Short
    forecasts take it in their own window; long series get it from
    :func:`~tidemark.operators.ranks.exact_quantiles`.
    """
    if fixed is not None:
        limited = df.withColumn("threshold", F.lit(float(fixed)))
    elif series.short_keys:
        whole = Window.partitionBy(*series.keys)
        limited = df.withColumn("threshold", F.percentile(value, percentile / 100).over(whole))
    else:
        df = written(df, "forecast")
        limited = df.join(quantile_columns(df, series.keys, value, {"threshold": percentile / 100}), list(series.keys))
    return limited.withColumn("is_green", F.col(value) <= F.col("threshold"))


def green_windows(marked: DataFrame, series: Series, value: str = PREDICTED, digits: int = 2) -> DataFrame:
    """Unbroken runs of green hours: start, end, length, mean, smallest and largest value."""
    run = islands(marked, series, F.col("is_green"))
    return (
        run.filter(F.col("_island").isNotNull())
        .groupBy(*series.keys, F.col("_island").alias("start_time"))
        .agg(
            F.max(series.time).alias("end_time"),
            F.count(F.lit(1)).alias("duration_hours"),
            scalars.half_even(F.avg(value), digits).alias("avg_intensity"),
            scalars.half_even(F.min(value), digits).alias("min_intensity"),
            scalars.half_even(F.max(value), digits).alias("max_intensity"),
        )
    )


def green_summary(marked: DataFrame, keys: Sequence[str], value: str = PREDICTED) -> DataFrame:
    """Green hours and share, mean of each side, and what moving to green saves."""
    green = F.col("is_green")
    sides = marked.groupBy(*keys).agg(
        scalars.half_even(F.max("threshold"), 2).alias("threshold"),
        F.count_if(green).alias("green_hours"),
        F.count(F.lit(1)).alias("total_hours"),
        scalars.half_even(F.avg(F.when(green, F.col(value))), 2).alias("avg_green"),
        scalars.half_even(F.avg(F.when(~green, F.col(value))), 2).alias("avg_red"),
    )
    red = F.col("avg_red")
    return sides.withColumns(
        {
            "green_pct": scalars.half_even(F.col("green_hours") / F.col("total_hours") * 100, 1),
            "co2_savings_pct": F.when(red > 0, scalars.half_even((red - F.col("avg_green")) / red * 100, 1)),
        }
    )


def start_options(forecast: DataFrame, series: Series, runtimes: Sequence[int], value: str = PREDICTED) -> DataFrame:
    """For every forecast, runtime and latest start: the best start so far.

    One row per (key, runtime, max_start). ``best_start`` is the offset in hours with
    the smallest mean over ``runtime`` hours among the starts up to ``max_start``; the
    earliest wins ties. The table depends on the forecast only, not on the jobs.
    """
    runtimes = sorted(set(runtimes))
    keys = list(series.keys)
    placed = with_position(forecast, series, POSITION)
    counted = replace(series, index=None if series.short_keys else POSITION)

    def means(w) -> dict[str, Column]:
        frames = {r: w.rowsBetween(0, r - 1) for r in runtimes}
        return {f"_m{r}": F.when(F.count(F.lit(1)).over(f) == r, F.avg(value).over(f)) for r, f in frames.items()}

    windows = bounded_window(placed.select(*keys, series.time, POSITION, value), counted, 0, max(runtimes) - 1, means)
    long = windows.select(
        *keys,
        series.time,
        F.col(POSITION).alias("max_start"),
        F.inline(
            F.array(*[F.struct(F.lit(r).alias("runtime_hours"), F.col(f"_m{r}").alias("mean_intensity")) for r in runtimes])
        ),
    ).filter(F.col("mean_intensity").isNotNull())
    best = F.min(F.struct("mean_intensity", F.col("max_start").alias("best_start"), F.col(series.time).alias("start_time")))
    group = [*keys, "runtime_hours"]
    upto = (Window.unboundedPreceding, Window.currentRow)
    if series.short_keys:
        # A forecast has at most its horizon in hours of starts per runtime.
        so_far = Window.partitionBy(*group).orderBy("max_start").rowsBetween(*upto)
        found = long.withColumns({"_best": best.over(so_far), "immediate_intensity": F.first("mean_intensity").over(so_far)})
    else:
        # Running minimum within chunks; each chunk takes over the minimum of those before it.
        long = written(long.withColumn(CHUNK, floor_div(F.col("max_start"), series.chunk_steps)), "starts")
        inside = Window.partitionBy(*group, CHUNK).orderBy("max_start").rowsBetween(*upto)
        chunks = long.groupBy(*group, CHUNK).agg(best.alias("_low"), F.min_by("mean_intensity", "max_start").alias("_first"))
        over = Window.partitionBy(*group).orderBy(CHUNK)
        carried = chunks.select(
            *group,
            CHUNK,
            F.min("_low").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_first").over(over.rowsBetween(*upto)).alias("immediate_intensity"),
        )
        placed_best = long.withColumn("_own", best.over(inside)).join(carried, [*group, CHUNK])
        found = placed_best.withColumn("_best", F.array_min(F.array_compact(F.array("_own", "_before"))))
    return found.select(
        *keys,
        "runtime_hours",
        "max_start",
        "_best",
        "immediate_intensity",
    ).select(
        *keys,
        "runtime_hours",
        "max_start",
        F.col("_best.best_start").alias("hours_to_wait"),
        F.col("_best.start_time").alias("recommended_start"),
        F.col("_best.mean_intensity").alias("expected_intensity"),
        "immediate_intensity",
    )


def plan_jobs(
    jobs: DataFrame,
    options: DataFrame,
    keys: Sequence[str] = ("zone",),
    energy_is_rate: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Best start, intensities and savings for each job.

    Jobs carry the keys, ``runtime_hours``, ``flexibility_hours`` (null: no limit) and
    ``energy_kwh``. Each job looks up one row of :func:`start_options` by equality, so
    there is no range join. A job longer than the forecast gets nulls, or an error when
    ``strict``.
    """
    keys = list(keys)
    latest = options.groupBy(*keys, "runtime_hours").agg(F.max("max_start").alias("_latest"))
    capped = jobs.join(latest, [*keys, "runtime_hours"], "left").withColumn(
        "max_start", F.least(F.col("_latest"), F.coalesce("flexibility_hours", F.col("_latest")))
    )
    found = capped.join(options, [*keys, "runtime_hours", "max_start"], "left").drop("_latest", "max_start")
    if strict:
        found = found.withColumn(
            "hours_to_wait",
            F.when(
                F.col("hours_to_wait").isNull(),
                F.raise_error(F.lit("forecast too short for the runtime")).cast("long"),
            ).otherwise(F.col("hours_to_wait")),
        )
    energy = F.col("energy_kwh") * F.col("runtime_hours") if energy_is_rate else F.col("energy_kwh")
    now, best = scalars.co2_kg(F.col("immediate_intensity"), energy), scalars.co2_kg(F.col("expected_intensity"), energy)
    saved = now - best
    pct = F.when(now > 0, saved / F.nullif(now, F.lit(0.0)) * 100).otherwise(F.when(now.isNotNull(), 0.0))
    return found.select(
        *jobs.columns,
        "hours_to_wait",
        "recommended_start",
        scalars.half_even(F.col("expected_intensity"), 2).alias("expected_intensity"),
        scalars.half_even(F.col("immediate_intensity"), 2).alias("immediate_intensity"),
        scalars.half_even(now, 3).alias("immediate_co2_kg"),
        scalars.half_even(best, 3).alias("optimal_co2_kg"),
        scalars.half_even(saved, 3).alias("co2_saved_kg"),
        scalars.half_even(pct, 1).alias("co2_savings_pct"),
        F.when(
            F.col("hours_to_wait") > 0,
            F.format_string(
                WAIT_TEXT,
                F.col("hours_to_wait"),
                F.date_format("recommended_start", "yyyy-MM-dd HH:mm:ss"),
                saved,
                pct,
            ),
        )
        .when(F.col("hours_to_wait") == 0, NOW_TEXT)
        .alias("recommendation"),
    )


def window_around_minimum(forecast: DataFrame, series: Series, value: str = PREDICTED, before: int = 1, after: int = 2, last: int = 23) -> DataFrame:
    """Offsets from just before to just after each forecast's first smallest hour."""
    placed = with_position(forecast, series, POSITION)
    low = placed.groupBy(*series.keys).agg(
        F.min(value).alias("lowest"), F.min_by(POSITION, F.struct(value, POSITION)).alias("low_index")
    )
    return low.select(
        *series.keys,
        "lowest",
        "low_index",
        F.greatest(F.col("low_index") - before, F.lit(0)).alias("start_index"),
        F.least(F.col("low_index") + after, F.lit(last)).alias("end_index"),
    )


def lowest_zone(df: DataFrame, value: str, zone: str = "zone") -> DataFrame:
    """The zone with the smallest value; first name on ties."""
    return df.agg(F.min_by(zone, F.struct(value, zone)).alias(zone), F.min(value).alias(value))


def impact(jobs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over planned jobs."""
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.sum("co2_saved_kg").alias("co2_saved_kg"),
        F.avg(F.coalesce("hours_to_wait", F.lit(0))).alias("average_delay_hours"),
    ).withColumn("tree_equivalents", scalars.tree_equivalents(F.col("co2_saved_kg")))
