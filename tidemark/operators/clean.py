"""From raw observations to a clean, regular table per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import parsing, scalars
from tidemark.operators.series import Series, regularise_and_fill


def project_signal(
    df: DataFrame,
    signal: str,
    value_fields: Mapping[str, str] | None = None,
    zone: Column | None = None,
    time: str = "datetime",
) -> DataFrame:
    """``(zone, datetime, <signal>)`` from one raw signal table.

    The value field comes from ``value_fields`` and is ``value`` by default. A table
    without it yields no rows.
    """
    field = (value_fields or {}).get(signal, "value")
    zone = F.col("zone") if zone is None else zone
    if field not in df.columns or time not in df.columns:
        return df.sparkSession.createDataFrame([], f"zone string, datetime timestamp, `{signal}` double")
    return df.select(
        zone.alias("zone"),
        parsing.parse_utc(F.col(time)).alias("datetime"),
        parsing.to_number(F.col(field)).alias(signal),
    )


def select_and_rename(df: DataFrame, mapping: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """Keep and rename the mapped columns that exist; a missing required one is an error."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items() if old in df.columns])


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Read NaN as missing in every floating-point column."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: parsing.nan_to_null(F.col(c)) for c in floating}) if floating else df


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate, so copies of a key are reduced before the shuffle; a key copied
    across a third of the table still sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before, distinct keys, and rows a keep-first would remove."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def pivot_signals(
    long: DataFrame,
    signals: Mapping[str, str],
    order: Sequence[str],
    keys: Sequence[str] = ("zone", "datetime"),
    signal: str = "signal",
    value: str = "value",
) -> DataFrame:
    """One row per key with a column per signal: a full outer join of all signals.

    Works on the long table (key, signal, value), so any number of signals costs one
    shuffle. Repeated readings of a signal are resolved to the first in ``order`` by
    the same aggregate.
    """
    rank = F.struct(*order)
    return long.groupBy(*keys).agg(
        *[
            F.min_by(F.col(value), F.when(F.col(signal) == raw, rank)).alias(clean)
            for raw, clean in signals.items()
        ]
    )


def join_signals(tables: Sequence[DataFrame], keys: Sequence[str] = ("zone", "datetime")) -> DataFrame:
    """Chained full outer join, for signals that do not share one long table."""
    if not tables:
        raise ValueError("no signal tables")
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.join(table, list(keys), "full")
    return merged


def clip_columns(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: scalars.clip(F.col(c), lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns})


def count_out_of_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows outside the range, per column."""
    present = {c: r for c, r in ranges.items() if c in df.columns}
    counts = df.agg(*[F.count_if(scalars.out_of_range(F.col(c), *r)).alias(c) for c, r in present.items()])
    return counts.unpivot([], list(present), "column", "outliers")


def training_window(df: DataFrame, start: str, end: str, time: str = "datetime") -> DataFrame:
    """Rows from midnight of ``start`` to the last whole second of ``end``."""
    first = F.lit(start).cast("timestamp")
    last = F.lit(end).cast("timestamp") + F.expr("interval '1' day") - F.expr("interval '1' second")
    return df.filter((F.col(time) >= first) & (F.col(time) <= last))


def map_zone(df: DataFrame, dimension: DataFrame, columns: Sequence[str], key: str = "zone", default: str = "unknown") -> DataFrame:
    """Attach dimension columns to each zone; unmatched zones get the default.

    The dimension is left to the planner's size check: broadcast when small, joined by
    shuffle when not.
    """
    looked_up = dimension.select(key, *[F.col(c).alias(f"_dim_{c}") for c in columns])
    return df.join(looked_up, key, "left").select(
        *df.columns, *[F.coalesce(F.col(f"_dim_{c}"), F.lit(default)).alias(c) for c in columns]
    )


def clean_series(
    df: DataFrame,
    series: Series,
    value_columns: Sequence[str],
    ranges: Mapping[str, tuple[float, float]],
    window: tuple[str, str] | None = None,
) -> DataFrame:
    """Regular axis, forward then backward fill, clip, then the date window.

    The window comes last: values outside it may fill rows inside it.
    """
    filled = regularise_and_fill(df, series, value_columns)
    clipped = clip_columns(filled, ranges)
    return training_window(clipped, *window, time=series.time) if window else clipped


def clean_signals(
    long: DataFrame,
    signals: Mapping[str, str],
    order: Sequence[str],
    series: Series,
    ranges: Mapping[str, tuple[float, float]],
    dimension: DataFrame | None = None,
    dimension_columns: Sequence[str] = (),
    window: tuple[str, str] | None = None,
) -> DataFrame:
    """From long (key, time, signal, value) readings to the clean wide table.

    Signals are pivoted and their repeats resolved to the first in ``order`` by one aggregate; then
    axis, fill, clip, zone mapping and the date window.
    """
    wide = pivot_signals(long, signals, order, (*series.keys, series.time))
    table = clean_series(wide, series, list(signals.values()), ranges, window)
    return map_zone(table, dimension, dimension_columns, series.keys[0]) if dimension is not None else table


def merge_on_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("zone", "datetime")) -> DataFrame:
    return left.join(right, list(keys), "inner")


def merge_loss(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("zone", "datetime")) -> DataFrame:
    """Per zone: left rows, rows that find a partner, rows lost and their share."""
    zone = keys[0]
    probe = right.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return (
        left.select(*keys)
        .join(probe, list(keys), "left")
        .groupBy(zone)
        .agg(F.count(F.lit(1)).alias("left_rows"), F.count("_hit").alias("merged_rows"))
        .withColumn("lost_rows", F.col("left_rows") - F.col("merged_rows"))
        .withColumn("lost_pct", F.col("lost_rows") / F.col("left_rows") * 100)
    )


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("zone", "datetime")) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of all tables; columns a table lacks are null."""
    if not tables:
        raise ValueError("no tables")
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result
