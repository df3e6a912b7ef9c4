"""Calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The season of each month, by name and by number.
SEASON_MONTHS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}
SEASON_NUMBERS = {"Winter": 1, "Spring": 2, "Summer": 3, "Fall": 4}


def season_name(ts: Column) -> Column:
    month = F.month(ts)
    return F.when(month.isNull(), None).otherwise(
        F.coalesce(*[F.when(month.isin(*months), F.lit(name)) for name, months in SEASON_MONTHS.items()])
    )


def season_number(ts: Column) -> Column:
    month = F.month(ts)
    return F.coalesce(*[F.when(month.isin(*SEASON_MONTHS[n]), F.lit(i)) for n, i in SEASON_NUMBERS.items()])


def temporal_columns(ts: Column, profile: str = "train") -> dict[str, Column]:
    """The calendar columns of a feature profile.

    ``train`` counts hours 6 to 17 as daytime and names the season; ``serve`` counts
    hours 6 to 20 and numbers the season.
    """
    hour, weekday = F.hour(ts), F.weekday(ts)
    common = {
        "hour_of_day": hour,
        "day_of_week": weekday,
        "month": F.month(ts),
        "is_weekend": (weekday >= 5).cast("int"),
    }
    if profile == "serve":
        return {
            **common,
            "is_daytime": hour.between(6, 20).cast("int"),
            "season": season_number(ts),
        }
    if profile != "train":
        raise ValueError(f"unknown profile {profile!r}")
    return {
        **common,
        "day_of_month": F.dayofmonth(ts),
        "quarter": F.quarter(ts),
        "day_of_year": F.dayofyear(ts),
        "week_of_year": F.weekofyear(ts),
        "year": F.year(ts),
        "is_daytime": hour.between(6, 17).cast("int"),
        "season": season_name(ts),
    }


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def cyclic_columns(ts: Column, profile: str = "train") -> dict[str, Column]:
    parts = {"hour": (F.hour(ts), 24), "month": (F.month(ts), 12)}
    if profile == "train":
        parts["dow"] = (F.weekday(ts), 7)
    columns = {}
    for name, (value, period) in parts.items():
        columns[f"{name}_sin"], columns[f"{name}_cos"] = cyclic(value, period)
    return columns


def slice_text_columns(ts: Column) -> dict[str, Column]:
    """Calendar slices as text, for slice reports."""
    return {
        "hour_of_day": F.hour(ts).cast("string"),
        "day_of_week": F.date_format(ts, "EEEE"),
        "month": F.month(ts).cast("string"),
        "season": season_name(ts),
        "is_weekend": F.when(F.weekday(ts) >= 5, "True").otherwise("False"),
    }
