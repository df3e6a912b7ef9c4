"""Lags and rolling statistics stated as SQL text.

The many columns of a step need one call to the JVM instead of several per column.
Statistics are Spark's own sliding frames, whose deviation is built from means and squared
deviations and so does not lose digits when values move far from where they began. Frames of
one length share a window step. ``over`` is a window such as ``Series.over`` gives.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

STATISTICS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "count": "count"}


def add_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add or replace columns given as SQL text."""
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{sql} AS `{name}`" for name, sql in columns.items()])


def add_lags(df: DataFrame, over: str, columns: Sequence[str], lags: Sequence[int], name: Callable[[str, int], str]) -> DataFrame:
    """Earlier values of several columns."""
    return add_columns(df, {name(c, n): f"lag(`{c}`, {n}) OVER ({over})" for n in lags for c in columns})


def add_rolling(
    df: DataFrame,
    over: str,
    rolling: Mapping[str, Mapping[int, Sequence[str]]],
    name: Callable[[str, str, int], str],
) -> DataFrame:
    """Statistics over the current and the ``n - 1`` rows before it, nulls left out.

    ``rolling`` maps column -> rows -> statistics; ``name(column, statistic, rows)`` names
    the results. Besides mean, std, min and max there is count. Every length is computed by the
    same formula.
    """
    results = {
        name(c, stat, n): f"{STATISTICS[stat]}(`{c}`) OVER ({over} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for c, windows in rolling.items()
        for n, stats in windows.items()
        for stat in stats
    }
    return add_columns(df, results)
