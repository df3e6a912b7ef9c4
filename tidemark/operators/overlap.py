"""Joins of intervals that overlap in time.

Both sides are cut into time bins and joined on keys and bin, so the join is one of equality that is shuffled, split when
skewed and spilled like any other; an interval longer than a bin stands in each bin that it touches. A pair is told in the
first bin that both sides share and nowhere else, so no distinct follows. ``bin_seconds`` decides about the work, never
about the rows: near the usual length of the longer side an interval stands in about two bins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import floor_div

DAY = 86_400
BIN = "_bin"


def _binned(df: DataFrame, keys: Sequence[str], span: tuple[str, str], size: int, side: str) -> DataFrame:
    """Rows with a span, once for each bin that it touches, with the first of them."""
    start, stop = (F.unix_micros(F.col(c).cast("timestamp")) for c in span)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys], start < stop)
    first = floor_div(start, size)
    bins = F.explode(F.sequence(first, floor_div(stop - 1, size))).alias(BIN)
    return df.where(known).select("*", first.alias(f"_first_{side}"), bins)


def overlaps(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_seconds: int = DAY,
) -> DataFrame:
    """All pairs of equal keys whose half-open spans [start, stop) share some time, with ``overlap_seconds``.

    Left columns, then the right ones but the keys; a column that both sides have is an error. Null
    keys, null ends and empty or reversed spans overlap with nothing. Repeated rows give a pair each.
    """
    keys = list(keys)
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    size = bin_seconds * 1_000_000
    pairs = _binned(left, keys, left_span, size, "left").join(_binned(right, keys, right_span, size, "right"), [*keys, BIN])
    start = F.greatest(*[F.col(s[0]).cast("timestamp") for s in (left_span, right_span)])
    stop = F.least(*[F.col(s[1]).cast("timestamp") for s in (left_span, right_span)])
    told = (F.col(BIN) == F.greatest("_first_left", "_first_right")) & (start < stop)
    shown = [*left.columns, *[c for c in right.columns if c not in keys]]
    return pairs.where(told).select(*[F.col(f"`{c}`") for c in shown], ((F.unix_micros(stop) - F.unix_micros(start)) / 1e6).alias("overlap_seconds"))


def overlap_totals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_seconds: int = DAY,
) -> DataFrame:
    """The ids of all left rows with the number of right spans they overlap and the seconds shared (0 where none).

    ``left_id`` names the rows; rows of the same id are added up. Right spans that overlap each other
    count each for itself.
    """
    narrow = [left.select(*dict.fromkeys([*keys, *left_id, *left_span])), right.select(*dict.fromkeys([*keys, *right_span]))]
    pairs = overlaps(narrow[0], narrow[1], keys, left_span, right_span, bin_seconds).select(*left_id, "overlap_seconds")
    # Rows without a pair join the others before the one aggregate instead of by another join.
    both = pairs.unionByName(left.select(*left_id, F.lit(None).cast("double").alias("overlap_seconds")))
    return both.groupBy(*left_id).agg(
        F.count("overlap_seconds").alias("overlapping"), F.coalesce(F.sum("overlap_seconds"), F.lit(0.0)).alias("overlap_seconds")
    )
