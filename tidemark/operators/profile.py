"""Distributions, statistics and coverage of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_even
from tidemark.functions import buckets, calendar
from tidemark.operators.ranks import quantile_columns
from tidemark.operators.series import top_n
from tidemark.session import written
from tidemark.operators.series import CHUNK, Series, with_chunk

SLICES = ("hour_of_day", "day_of_week", "season", "month", "is_weekend", "carbon_intensity_bucket")


def add_slices(df: DataFrame, value: str, time: str = "datetime") -> DataFrame:
    """The six slice columns as text."""
    return df.withColumns(
        {**calendar.slice_text_columns(F.col(time)), "carbon_intensity_bucket": buckets.report_level(F.col(value))}
    )


def explode_slices(df: DataFrame, dimensions: Sequence[str], *keep: str) -> DataFrame:
    """One row per (row, slice dimension); rows without a slice value are left out."""
    pairs = F.array(*[F.struct(F.lit(d).alias("slice"), F.col(d).cast("string").alias("slice_value")) for d in dimensions])
    return df.select(*keep, F.inline(pairs)).filter(F.col("slice_value").isNotNull())


def slice_distribution(df: DataFrame, dimensions: Sequence[str], threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Share of each slice against an even spread, for all dimensions in one scan.

    The flags compare the rounded share with the unrounded expectation.
    """
    by = list(by)
    counts = explode_slices(df, dimensions, *by).groupBy(*by, "slice", "slice_value").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy(*by, "slice")
    share = half_even(F.col("count") / F.sum("count").over(whole) * 100, 2)
    return (
        counts.withColumn("percentage", share)
        .withColumn("_expected", 100 / F.count(F.lit(1)).over(whole))
        .select(
            *by,
            "slice",
            "slice_value",
            "count",
            "percentage",
            half_even(F.col("_expected"), 2).alias("expected_pct"),
            half_even((F.col("percentage") - F.col("_expected")) / F.col("_expected") * 100, 2).alias("deviation_pct"),
            (F.col("percentage") < F.col("_expected") * threshold).alias("is_underrepresented"),
            (F.col("percentage") > F.col("_expected") * (2 - threshold)).alias("is_overrepresented"),
        )
    )


def slice_target_stats(df: DataFrame, dimensions: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, range, median and missing share of the target per slice."""
    long = explode_slices(df, dimensions, *by, target)
    keys = [*by, "slice", "slice_value"]
    y = F.col(target)
    stats = long.groupBy(*keys).agg(
        F.count(y).alias("count"),
        half_even(F.avg(y), 2).alias("mean"),
        half_even(F.stddev_samp(y), 2).alias("std"),
        half_even(F.min(y), 2).alias("min"),
        half_even(F.max(y), 2).alias("max"),
        half_even(F.avg(y.isNull().cast("int")) * 100, 2).alias("missing_pct"),
    )
    medians = quantile_columns(long, keys, target, {"median": 0.5})
    return stats.join(medians, keys, "left").withColumn("median", half_even(F.col("median"), 2))


def issue_total(distribution: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of under- plus over-represented slices."""
    flags = F.col("is_underrepresented").cast("int") + F.col("is_overrepresented").cast("int")
    return distribution.groupBy(*by).agg(F.sum(flags).alias("issues"))


def with_status(distribution: DataFrame) -> DataFrame:
    return distribution.withColumn(
        "status", buckets.representation_status(F.col("is_underrepresented"), F.col("is_overrepresented"))
    )


def coverage(df: DataFrame, zone: str = "zone", time: str = "datetime") -> DataFrame:
    """Rows, share, first and last time per zone."""
    per_zone = df.groupBy(zone).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )
    total = per_zone.agg(F.sum("rows").alias("_total")).withColumn("_one", F.lit(1))
    return (
        per_zone.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .withColumn("share_pct", F.col("rows") / F.col("_total") * 100)
        .drop("_one", "_total")
    )


def step_gaps(df: DataFrame, series: Series = Series()) -> DataFrame:
    """Consecutive rows of a key that are not exactly one step apart.

    Within a chunk the previous row is a window lag; the first row of a chunk looks at
    the last row of the chunk before it, taken from the per-chunk summary.
    """
    base = with_chunk(df.select(*series.keys, series.time), series)
    edges = base.groupBy(*series.keys, CHUNK).agg(F.max(series.time).alias("_end"))
    before = edges.select(*series.keys, CHUNK, F.lag("_end").over(series.summary_window()).alias("_before"))
    local = base.withColumn("_prev", F.lag(series.time).over(series.chunk_window()))
    seconds = (F.unix_micros(series.time) - F.unix_micros("previous_time")) / 1_000_000
    return (
        local.join(before, [*series.keys, CHUNK])
        .select(*series.keys, series.time, F.coalesce("_prev", "_before").alias("previous_time"))
        .filter(F.col("previous_time").isNotNull())
        .withColumn("step_seconds", seconds.cast("long"))
        .filter(F.col("step_seconds") != series.step_seconds)
    )


def regularity(df: DataFrame, series: Series = Series()) -> DataFrame:
    """Per key: rows, steps of another length, and whether the key is regular."""
    gaps = step_gaps(df, series).groupBy(*series.keys).agg(
        F.count(F.lit(1)).alias("irregular_steps"), F.max("step_seconds").alias("longest_step")
    )
    rows = df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(gaps, list(series.keys), "left").select(
        *series.keys,
        "rows",
        F.coalesce("irregular_steps", F.lit(0)).alias("irregular_steps"),
        F.coalesce("longest_step", F.lit(series.step_seconds)).cast("long").alias("longest_step"),
        F.col("irregular_steps").isNull().alias("is_regular"),
    )


def value_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range, mean, deviation and null count per column: one scan, one result row each."""
    stats = {
        "min": F.min,
        "max": F.max,
        "mean": F.avg,
        "std": F.stddev_samp,
        "nulls": lambda c: F.count_if(F.col(c).isNull()).cast("double"),
    }
    one = df.agg(*[f(c).cast("double").alias(f"{c}|{name}") for c in columns for name, f in stats.items()])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{name}`").alias(name) for name in stats])
                    for c in columns
                ]
            )
        )
    ).withColumn("nulls", F.col("nulls").cast("long"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count and share per column."""
    columns = list(columns or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (
        one.unpivot(["_rows"], columns, "column", "nulls")
        .withColumn("null_pct", F.col("nulls") / F.nullif(F.col("_rows"), F.lit(0)) * 100)
        .drop("_rows")
    )


def worst_null_rate(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Largest null share over the columns."""
    rates = [F.avg(F.col(c).isNull().cast("int")) for c in columns]
    return df.groupBy(*by).agg((F.greatest(*rates) if len(rates) > 1 else rates[0]).alias("max_null_rate"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Largest over smallest class count and its severity; unknown labels are left out."""
    counts = df.filter(F.col(label) != "Unknown").groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.sum("_n").alias("samples"), (F.max("_n") / F.min("_n")).alias("imbalance_ratio")
    ).withColumn("severity", buckets.severity(F.col("imbalance_ratio")))


def dataset_info(df: DataFrame, split: str = "split", zone: str = "zone", time: str = "datetime") -> DataFrame:
    """Rows, date range and number of zones per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).cast("date").alias("start_date"),
        F.max(time).cast("date").alias("end_date"),
        F.count_distinct(zone).alias("n_zones"),
    )


def zone_list(df: DataFrame, zone: str = "zone") -> DataFrame:
    return df.select(zone).filter(F.col(zone).isNotNull()).distinct()


def zone_target_stats(df: DataFrame, target: str, zone: str = "zone") -> DataFrame:
    """Mean, deviation, range and median of the target per zone."""
    y = F.col(target)
    stats = df.groupBy(zone).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")
    )
    return stats.join(quantile_columns(df, [zone], target, {"median": 0.5}), zone)


def exact_distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def _long(df: DataFrame, columns: Sequence[str], kind: str, by: Sequence[str] = ()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*by, F.inline(pairs))


def numeric_profile(
    df: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float] | None = None, approximate: bool = False, by: Sequence[str] = ()
) -> DataFrame:
    """Count, nulls, zeros, range, moments, distinct values and quantiles per column (and group).

    Two passes over the table: moments, and the counted values that serve distinct and quantiles.
    """
    quantiles = quantiles or {"p25": 0.25, "median": 0.5, "p75": 0.75}
    keys = [*by, "column"]
    long = _long(df, columns, "double", by)
    v = F.col("value")
    stats = long.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.count_if(v.isNull()).alias("nulls"),
        F.count_if(F.coalesce(v == 0, F.lit(False))).alias("zeros"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        *([F.approx_count_distinct(v).alias("distinct")] if approximate else []),
    )
    counts = written(long.filter(v.isNotNull()).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("times")), "profile-counts")
    if not approximate:
        distinct = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("distinct"))
        stats = stats.join(distinct, keys, "left").fillna(0, ["distinct"])
    return stats.join(quantile_columns(counts, keys, "value", quantiles, weight="times"), keys, "left")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column; ties in value order."""
    counts = _long(df, columns, "string").filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count")
    )
    return top_n(counts, ["column"], [F.col("count").desc(), F.col("value")], k, "rank")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width counts per column, non-empty bins."""
    long = _long(df, columns, "double").filter(F.col("value").isNotNull())
    edges = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    position = (F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * bins
    index = F.coalesce(F.least(F.floor(position), F.lit(bins - 1)), F.lit(0)).cast("int")
    # One row per profiled column.
    return long.join(F.broadcast(edges), "column").groupBy("column", index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))

