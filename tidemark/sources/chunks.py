"""Time chunks to fetch, and which of them are still missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BYTES = 10


def _days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def backfill_chunks(spans: DataFrame, days: int, start: str = "start", end: str = "end") -> DataFrame:
    """Half-open chunks of ``days`` from start to end; the last one is cut at the end."""
    last = F.col(end) - F.expr("interval '1' microsecond")
    return (
        spans.filter(F.col(start) < F.col(end))
        .withColumn("chunk_start", F.explode(F.sequence(F.col(start), last, _days(days))))
        .withColumn("chunk_end", F.least(F.col("chunk_start") + _days(days), F.col(end)))
    )


def hourly_chunks(nows: DataFrame, now: str = "now", lookback_hours: int = 2, window_hours: int = 1) -> DataFrame:
    """The windows that cover the last ``lookback_hours`` before the current hour."""
    end = F.date_trunc("hour", F.col(now))
    width = F.make_dt_interval(F.lit(0), F.lit(window_hours))
    first = end - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))
    return nows.withColumn(
        "chunk_start", F.explode(F.sequence(first, end - F.expr("interval '1' microsecond"), width))
    ).withColumn("chunk_end", F.col("chunk_start") + width)


def inclusive_chunks(spans: DataFrame, days: int, start: str = "start", end: str = "end") -> DataFrame:
    """Chunks whose end day belongs to them; the next chunk starts a day later."""
    last = F.col(end) - F.expr("interval '1' microsecond")
    return (
        spans.filter(F.col(start) < F.col(end))
        .withColumn("chunk_start", F.explode(F.sequence(F.col(start), last, _days(days + 1))))
        .withColumn("chunk_end", F.least(F.col("chunk_start") + _days(days), F.col(end)))
    )


def landed(primary: DataFrame, mirror: DataFrame, by: Sequence[str], min_bytes: int = MIN_BYTES) -> DataFrame:
    """Chunks present in both stores with at least ``min_bytes``."""
    big = F.col("bytes") >= min_bytes
    return primary.filter(big).select(*by).join(mirror.filter(big).select(*by), list(by), "left_semi")


def pending_chunks(plan: DataFrame, done: DataFrame, by: Sequence[str]) -> DataFrame:
    return plan.join(done, list(by), "left_anti")


def chunk_file_name(start: Column, end: Column) -> Column:
    pattern = "yyyyMMdd'T'HHmmss'Z'"
    return F.concat(F.lit("start="), F.date_format(start, pattern), F.lit("_end="), F.date_format(end, pattern), F.lit(".jsonl"))
