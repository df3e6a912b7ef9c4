"""JSON payloads whose fields are not known beforehand, as VARIANT values.

A payload is parsed once into a variant; fields are then taken by path, so files of different shapes go through one plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNREADABLE = "unreadable payload"


def parse_payloads(df: DataFrame, payload: str, to: str = "payload_value") -> DataFrame:
    """Add the payload as a variant; null where it is null, empty or no JSON."""
    return df.withColumn(to, F.try_parse_json(F.nullif(F.trim(F.col(payload)), F.lit(""))))


def payload_shapes(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group the schema that holds all its payloads, and how many were readable.

    Fields are merged over rows, and types widened; a group without readable payloads has the shape VOID.
    """
    return df.groupBy(*by).agg(F.schema_of_variant_agg(F.col(value)).alias("shape"), F.count(value).alias("readable"))


def payload_fields(df: DataFrame, value: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Typed columns from ``name -> (path, type)``; null where a payload lacks the path or its value has another type."""
    taken = [F.try_variant_get(F.col(value), path, kind).alias(name) for name, (path, kind) in fields.items()]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (value, *fields)], *taken)


def payload_elements(df: DataFrame, value: str, path: str, to: str = "element") -> DataFrame:
    """One row per element of the array at ``path``, as a variant with its position; other payloads give no row."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (value, "position", to)]
    array = F.try_variant_get(F.col(value), path, "array<variant>")
    return df.select(*rest, F.posexplode(array).alias("position", to))


def path_issues(df: DataFrame, value: str, paths: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group the paths that some readable payload lacks or holds null, with their count, and its unreadable payloads.

    All paths are counted in one pass; null and empty payloads are unreadable.
    """
    known = F.col(value).isNotNull()
    lacks = [F.count_if(known & F.try_variant_get(F.col(value), p, "variant").isNull()).alias(f"_{i}") for i, p in enumerate(paths)]
    nulls = [F.count_if(F.coalesce(F.is_variant_null(F.try_variant_get(F.col(value), p, "variant")), F.lit(False))).alias(f"_null{i}") for i, p in enumerate(paths)]
    counted = df.groupBy(*by).agg(*lacks, *nulls, F.count_if(~known).alias("_unreadable"))
    rows = [F.struct(F.concat(F.lit("missing "), F.lit(p)).alias("issue"), (F.col(f"_{i}") + F.col(f"_null{i}")).alias("payloads")) for i, p in enumerate(paths)]
    rows.append(F.struct(F.lit(UNREADABLE).alias("issue"), F.col("_unreadable").alias("payloads")))
    return counted.select(*by, F.inline(F.array(*rows))).filter(F.col("payloads") > 0)
