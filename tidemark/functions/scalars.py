"""Small numeric and text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Kilograms of CO2 one tree stands for, and the texts of an hour's advice.
KG_PER_TREE = 13.3
ADVICE = {True: "✅ SCHEDULE NOW — Low carbon", False: "⏳ DEFER — High carbon"}
# Characters rewritten in metric names.
METRIC_KEY_WORDS = {"+": "plus", "%": "pct", "<": "lt", ">": "gt", "=": "eq"}
METRIC_KEY_DROPPED = r"[()\-.]"
METRIC_KEY_UNDERSCORE = r"[ /]"


def half_even(value: Column, digits: int) -> Column:
    """Round half to even. Float noise six digits further on is dropped first, so the
    result does not depend on the order in which a sum was added up."""
    return F.bround(F.round(value, digits + 6), digits)


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; a missing value stays missing (least and greatest skip nulls)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def out_of_range(value: Column, low: float, high: float) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def floor_at(value: Column, low: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(value, F.lit(float(low))))


def signed_percent(ratio: Column) -> Column:
    """``+12.3%`` text of a ratio."""
    return F.format_string("%+.1f%%", half_even(ratio * 100, 1))


def parse_percent(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[%+]", "").try_cast("double")


def metric_key(*parts: Column) -> Column:
    """Parts joined by two underscores, in characters a metric store accepts."""
    key = F.regexp_replace(F.concat_ws("__", *parts), METRIC_KEY_UNDERSCORE, "_")
    for mark, word in METRIC_KEY_WORDS.items():
        key = F.replace(key, F.lit(mark), F.lit(word))
    return F.regexp_replace(key, METRIC_KEY_DROPPED, "")


def min_max_scaled(value: Column, by: Sequence[str]) -> Column:
    """Position of the value between the group's smallest and largest; null when they are equal.

    Meant for report tables, whose groups hold a few slices each.
    """
    group = Window.partitionBy(*by)
    low, high = F.min(value).over(group), F.max(value).over(group)
    return (value - low) / F.nullif(high - low, F.lit(0.0))


def solar_potential(daytime: Column, cloud_pct: Column) -> Column:
    return daytime * (100 - cloud_pct) / 100


def solar_from_radiation(radiation: Column, cloud_pct: Column) -> Column:
    return radiation * (1 - cloud_pct / 100)


def temperature_demand(load: Column, temperature: Column, comfort: float = 15) -> Column:
    return load * F.abs(temperature - comfort) / 100


def temperature_distance(temperature: Column, comfort: float = 20) -> Column:
    return F.abs(temperature - comfort)


def clean_energy_score(carbon_free: Column, renewable: Column) -> Column:
    return (carbon_free + renewable) / 2


def co2_kg(intensity: Column, energy_kwh: Column) -> Column:
    return intensity * energy_kwh / 1000


def co2_kg_for_power(intensity: Column, energy_kwh: Column, runtime_hours: Column) -> Column:
    """Variant that reads the energy as used in every hour of the run."""
    return intensity * energy_kwh * runtime_hours / 1000


def tree_equivalents(kg: Column) -> Column:
    return kg / KG_PER_TREE


def advice(is_low: Column) -> Column:
    return F.when(is_low, ADVICE[True]).otherwise(ADVICE[False])


def first_metric(metrics: Column, *names: str) -> Column:
    """The first of several map entries that is present."""
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in names])
