"""Exact order statistics without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


VALUES_PER_RANGE = 1_000_000
LEAST_SPLITS, MOST_SPLITS = 64, 16_384


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Sequence[float],
    splits: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, one row per (group, quantile).

    Equal values are counted before the shuffle and written once. A quantile sketch then cuts each
    group into ``splits`` value ranges, range totals locate the wanted ranks, and only
    the ranges holding a wanted rank are sorted. One group may hold any share of the
    rows: its work is spread over its ranges, whose number grows with the largest group.
    ``weight`` names a column that says how often a row counts. Rows with a null group or value
    are left out.
    """
    by = list(by)
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counted = written(
        df.filter(reduce(and_, [F.col(c).isNotNull() for c in [*by, value]]))
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(times.cast("long").alias("_n")),
        "value-counts",
    )
    if splits is None:
        largest = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_d")).agg(F.max("_d").alias("d")).first()["d"] or 0
        splits = min(MOST_SPLITS, max(LEAST_SPLITS, -(-largest // VALUES_PER_RANGE)))
    points = [i / splits for i in range(1, splits)]
    cuts = counted.groupBy(*by).agg(
        F.percentile_approx("_v", points, F.lit(20 * splits)).alias("_cuts"), F.sum("_n").alias("_total")
    )
    if by:
        ranged = counted.join(cuts, by)
    else:
        # A single row of cut points.
        ranged = counted.withColumn("_all", F.lit(0)).join(F.broadcast(cuts.withColumn("_all", F.lit(0))), "_all")
    ranged = written(ranged.select(*by, "_v", "_n", "_total", _lower_bound(F.col("_cuts"), F.col("_v"), splits).alias("_range")), "value-ranges")
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_in_range"), F.max("_total").alias("_total"))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = totals.withColumn("_before", F.coalesce(F.sum("_in_range").over(upto), F.lit(0))).withColumn(
        "_q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))
    )
    rank = F.col("_q") * (F.col("_total") - 1)
    wanted = wanted.withColumn("_low", F.floor(rank)).withColumn("_high", F.ceil(rank))
    end = F.col("_before") + F.col("_in_range")
    wanted = wanted.filter(
        ((F.col("_low") >= F.col("_before")) & (F.col("_low") < end))
        | ((F.col("_high") >= F.col("_before")) & (F.col("_high") < end))
    ).select(*by, "_range", "_before", "_q", "_low", "_high", rank.alias("_rank"))

    keys = [*by, "_range"]
    needed = ranged.select(*keys, "_v", "_n").join(wanted.select(*keys, "_before").distinct(), keys)
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = needed.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
    matched = placed.select(*keys, "_v", (F.col("_end") - F.col("_n")).alias("_start"), "_end").join(
        wanted.drop("_before"), keys
    )
    low_in = (F.col("_low") >= F.col("_start")) & (F.col("_low") < F.col("_end"))
    high_in = (F.col("_high") >= F.col("_start")) & (F.col("_high") < F.col("_end"))
    return (
        matched.groupBy(*by, "_q")
        .agg(
            F.max(F.when(low_in, F.col("_v"))).alias("_lo"),
            F.max(F.when(high_in, F.col("_v"))).alias("_hi"),
            F.max(F.col("_rank") - F.col("_low")).alias("_part"),
        )
        .select(*by, F.col("_q").alias("quantile"), (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))
    )


def _lower_bound(cuts: Column, value: Column, splits: int) -> Column:
    """Number of leading cut points below ``value``: a binary search over the sorted array."""
    widths = [2**i for i in reversed(range(splits.bit_length()))]

    def probe(position: Column, width: Column) -> Column:
        below = F.try_element_at(cuts, position + width) < value
        return F.when(F.coalesce(below, F.lit(False)), position + width).otherwise(position)

    return F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), probe)


def quantile_columns(df: DataFrame, by: Sequence[str], value: str, named: dict[str, float], splits: int | None = None, weight: str | None = None) -> DataFrame:
    """The quantiles of :func:`exact_quantiles` as one column per name."""
    long = exact_quantiles(df, by, value, sorted(set(named.values())), splits, weight)
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(name) for name, q in named.items()]
    )
