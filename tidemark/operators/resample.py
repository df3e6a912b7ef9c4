"""Balancing classes by drawing rows with replacement.

Draws are hashes of (seed, class, draw number), so a lost task redraws the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65_536
DRAW_BLOCK = 10_000


def with_class_index(df: DataFrame, label: str, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Dense index 0..n-1 of each row within its class, and the class size.

    Rows are numbered inside hash buckets of ``key`` and shifted by the bucket offset,
    so a class of any size is spread over all buckets; a bucket is one task's sort. ``key``
    must identify a row.
    """
    base = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    sizes = base.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        label,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(label)).alias("_size"),
    )
    inside = Window.partitionBy(label, "_bucket").orderBy(*key)
    return (
        base.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [label, "_bucket"])
        .withColumn("_at", F.col("_offset") + F.col("_row") - 1)
        .drop("_bucket", "_row", "_offset")
    )


def _draws(sizes: DataFrame, label: str, wanted: Column, seed: int) -> DataFrame:
    """``wanted`` draws per class as (label, draw, _at)."""
    blocks = (
        sizes.withColumn("_want", wanted)
        .filter(F.col("_want") > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_want") - 1) / DRAW_BLOCK))))
        .repartition(label, "_block")
    )
    first = F.col("_block") * DRAW_BLOCK
    return blocks.withColumn(
        "_draw", F.explode(F.sequence(first, F.least(first + DRAW_BLOCK - 1, F.col("_want") - 1)))
    ).select(
        label,
        "_draw",
        F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col("_draw")), F.col("_size")).alias("_at"),
    )


def oversample(df: DataFrame, label: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """All rows plus draws that bring every class to the size of the largest."""
    indexed = with_class_index(df, label, key)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    largest = sizes.agg(F.max("_size").alias("_largest")).withColumn("_one", F.lit(1))
    full = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(largest), "_one").drop("_one")
    drawn = _draws(full, label, F.col("_largest") - F.col("_size"), seed)
    extra = drawn.join(indexed.drop("_size"), [label, "_at"]).select(*df.columns)
    return df.unionByName(extra)


def shuffled(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows spread over partitions in a random but repeatable order."""
    mix = F.xxhash64(F.lit(seed), *key)
    return df.repartition(mix).sortWithinPartitions(mix)


def _uniform(seed: int, *parts: Column) -> Column:
    """Uniform number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**31 - 1)) + 0.5) / float(2**31 - 1)


def normal(seed: int, *parts: Column) -> Column:
    """Standard normal number from two hashed uniforms."""
    radius = F.sqrt(-2 * F.ln(_uniform(seed, *parts, F.lit(1))))
    return radius * F.cos(2 * math.pi * _uniform(seed, *parts, F.lit(2)))


def oversample_with_noise(
    df: DataFrame,
    label: str,
    value: str,
    target: int,
    key: Sequence[str],
    noisy: Sequence[str],
    scale: float = 0.01,
    seed: int = 42,
) -> DataFrame:
    """Bring class ``value`` to ``target`` rows by noisy copies, flagged ``is_synthetic``.

    The noise of a column is normal with ``scale`` times the column's deviation within
    the class.
    """
    chosen = df.filter(F.col(label) == value)
    indexed = with_class_index(chosen, label, key)
    spread = chosen.groupBy(label).agg(
        F.count(F.lit(1)).alias("_size"), *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_sd_{c}") for c in noisy]
    )
    drawn = _draws(spread.select(label, "_size"), label, F.lit(target).cast("long") - F.col("_size"), seed)
    # One row of deviations.
    copies = drawn.join(indexed.drop("_size"), [label, "_at"]).join(F.broadcast(spread.drop("_size")), label)
    noise = {
        c: (F.col(c) + normal(seed, F.col("_draw"), F.lit(c)) * scale * F.col(f"_sd_{c}")).cast("double") for c in noisy
    }
    synthetic = copies.select(*[noise[c].alias(c) if c in noise else F.col(c) for c in df.columns], F.lit(True).alias("is_synthetic"))
    return df.withColumn("is_synthetic", F.lit(False)).unionByName(synthetic)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
