"""Strict and forgiving parsing of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_utc(text: Column) -> Column:
    """Timestamp from ISO text; malformed text is an error."""
    return F.to_timestamp(text)


def try_parse_utc(text: Column) -> Column:
    """Timestamp from ISO text; malformed text becomes null."""
    return F.try_to_timestamp(text)


def local_to_utc(text: Column, source_tz: str) -> Column:
    """Timestamp from wall-clock text written in ``source_tz``."""
    return F.to_utc_timestamp(F.to_timestamp(text), source_tz)


def format_iso_z(ts: Column) -> Column:
    return F.date_format(ts, ISO_Z)


def floor_to_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def to_number(text: Column) -> Column:
    """Double, or null when the text is no number. NaN counts as missing."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number), number)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
