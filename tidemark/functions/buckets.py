"""Value classes: buckets, severities, tiers, weights and status texts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_even

# Bucket names and edges.
LEVELS = ("Very Low", "Low", "Medium", "High", "Very High")
LEVEL_EDGES = (0.0, 100.0, 200.0, 350.0, 500.0, math.inf)
REPORT_EDGES = (0.0, 100.0, 200.0, 300.0, 400.0, math.inf)
RANGE_LABELS = ("Very Low (0-100)", "Low (100-200)", "Medium (200-350)", "High (350-500)", "Very High (500+)")
SERVICE_LABELS = ("Very Low (<100)", "Low (100-200)", "Medium (200-350)", "High (350-500)", "Very High (500+)")
TONE_EDGES = (160.0, 230.0)
TONES = ("green", "amber", "red")
SEVERITIES = (("LOW", 2), ("MODERATE", 5), ("HIGH", 10))
WORST_SEVERITY = "SEVERE"
TIERS = (("excellent", 0.60), ("good", 0.45), ("fair", 0.25))
LOWEST_TIER = "poor"
RARITY_WEIGHTS = ((100.0, 3.0), (200.0, 1.5))


def bucket(
    value: Column,
    edges: Sequence[float],
    labels: Sequence[str],
    closed: str = "left",
    include_lowest: bool = False,
    other: str | None = "Unknown",
) -> Column:
    """Label of the interval between two neighbouring edges that holds the value.

    ``closed`` names the side that belongs to the interval. Values outside all
    intervals, and missing values, get ``other``.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    cases = []
    for i, (low, high, label) in enumerate(zip(edges, edges[1:], labels)):
        if closed == "left":
            inside = value >= low
            if high != math.inf:
                inside = inside & (value < high)
        else:
            inside = value >= low if include_lowest and i == 0 else value > low
            if high != math.inf:
                inside = inside & (value <= high)
        cases.append(F.when(inside, F.lit(label)))
    return F.coalesce(*cases, F.lit(other))


def level(value: Column) -> Column:
    """Left-closed level; negative or missing is ``Unknown``."""
    return bucket(value, LEVEL_EDGES, LEVELS)


def level_with_range(value: Column) -> Column:
    return bucket(value, LEVEL_EDGES, RANGE_LABELS, other="nan")


def report_level(value: Column) -> Column:
    """Right-closed level used by slice reports; missing counts as zero."""
    return bucket(F.coalesce(value, F.lit(0.0)), REPORT_EDGES, LEVELS, closed="right", include_lowest=True, other="nan")


def digitize(value: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value."""
    return reduce(lambda total, e: total + (value >= e).cast("int"), edges, F.lit(0))


def level_index(value: Column) -> Column:
    return digitize(value, LEVEL_EDGES[1:-1])


def labelled(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label picked by :func:`digitize`."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), digitize(value, edges) + 1)


def service_level(value: Column) -> Column:
    return labelled(value, LEVEL_EDGES[1:-1], SERVICE_LABELS)


def tone(value: Column) -> Column:
    return labelled(value, TONE_EDGES, TONES)


def severity(ratio: Column) -> Column:
    """Class of an imbalance ratio."""
    return F.coalesce(*[F.when(ratio <= most, name) for name, most in SEVERITIES], F.lit(WORST_SEVERITY))


def improvement_pct(baseline: Column, value: Column, digits: int = 2) -> Column:
    return half_even((baseline - value) / F.nullif(baseline, F.lit(0.0)) * 100, digits)


def performance_tier(mae: Column, baseline: Column) -> Column:
    gain = (baseline - mae) / F.nullif(baseline, F.lit(0.0))
    tiers = [F.when(gain >= least, name) for name, least in TIERS]
    return F.coalesce(F.when(baseline == 0, "unknown"), F.when(baseline.isNull(), TIERS[0][0]), *tiers, F.lit(LOWEST_TIER))


def rarity_weight(value: Column) -> Column:
    """Sample weight that favours rare low values."""
    return F.coalesce(*[F.when(value < below, weight) for below, weight in RARITY_WEIGHTS], F.lit(1.0))


def zone_weight(zone: Column, favoured: str, weight: float = 3.0, synthetic: Column | None = None) -> Column:
    """Sample weight that favours one zone; synthetic rows always weigh 1."""
    chosen = zone == favoured
    if synthetic is not None:
        chosen = chosen & ~F.coalesce(synthetic, F.lit(False))
    return F.when(chosen, weight).otherwise(1.0)


def representation_status(under: Column, over: Column) -> Column:
    return F.when(under, "Under").when(over, "Over").otherwise("OK")


def change_status(change: Column, warning: float = 0.1, critical: float = 0.2) -> Column:
    return F.when(change > critical, "Warning").when(change > warning, "Watch").otherwise("OK")
