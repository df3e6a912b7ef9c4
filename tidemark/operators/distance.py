"""Distances between two distributions of a column: Kolmogorov-Smirnov and Wasserstein.

Both sides are counted per value, and the counted values are sorted in ranges over (feature, value). Sums per range and
feature, a few rows, give every range what lies before it; a running sum inside a range then is one of the whole column. No
range holds more than its share, however many values a feature has.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

VALUES_PER_RANGE = 200_000


def counted_values(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value, baseline_n, current_n; nulls and NaN are no values, equal values are one row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    sides = [df.select(F.lit(n).alias("side"), F.inline(pairs)) for n, df in (("baseline", baseline), ("current", current))]
    rows = reduce(DataFrame.unionByName, sides).where("value is not null and not isnan(value)")
    # -0.0 and 0.0 are one value.
    value = F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value"))
    sums = [F.count_if(F.col("side") == n).alias(f"{n}_n") for n in ("baseline", "current")]
    return rows.withColumn("value", value).groupBy("feature", "value").agg(*sums)


def distribution_distance(current: DataFrame, baseline: DataFrame, columns: Sequence[str], per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """feature, baseline_n, current_n, ks, wasserstein; null distances where a side has no value.

    ks is the largest gap between the two empirical distribution functions, wasserstein the area between
    them. Infinite values make the area infinite. Columns without any value are left out.
    """
    counted = written(counted_values(current, baseline, columns), "counted")
    ranges = max(1, -(-counted.count() // per_range))
    ranged = counted.repartitionByRange(ranges, "feature", "value").sortWithinPartitions("feature", "value")
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    # Ranges times features rows.
    chunks = ranged.groupBy("feature", "part").agg(
        F.sum("baseline_n").alias("_b"), F.sum("current_n").alias("_c"), F.min("value").alias("_first")
    )
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("feature").orderBy("part")
    whole = Window.partitionBy("feature")
    starts = chunks.select(
        "feature",
        "part",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_b", "_c")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("_b", "_c")],
        F.lead("_first").over(along).alias("_next"),
    )
    inside = Window.partitionBy("feature", "part").orderBy("value")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    share = {side: (F.sum(f"{side}_n").over(running) + F.col(f"_{side[0]}_before")) / F.nullif(F.col(f"_{side[0]}_all"), F.lit(0)) for side in ("baseline", "current")}
    rows = ranged.join(starts, ["feature", "part"]).select(
        "feature",
        "_b_all",
        "_c_all",
        *[c.alias(side[0]) for side, c in share.items()],
        (F.coalesce(F.lead("value").over(inside), F.col("_next")) - F.col("value")).alias("step"),
    )
    gap = F.abs(F.col("b") - F.col("c"))
    # After a column's last value both functions are 1.
    area = F.sum(F.when(gap > 0, gap * F.coalesce("step", F.lit(0.0))).when(gap == 0, 0.0))
    return rows.groupBy("feature").agg(F.first("_b_all").alias("baseline_n"), F.first("_c_all").alias("current_n"), F.max(gap).alias("ks"), area.alias("wasserstein"))
