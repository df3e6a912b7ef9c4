"""Queries over payloads of unknown shape and over tables stored side by side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.canonical import GRID_VALUES, Tables
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import payloads, tables

CI = GRID_VALUES[0]


def open_payloads(t: Tables) -> DataFrame:
    """Payloads of three shapes: a flat one, one with a nested part, one whose value is text; those with k = 13 are cut off."""
    flat = F.to_json(F.struct(F.col("whole").alias("value")))
    nested = F.to_json(F.struct(F.col("whole").alias("value"), F.struct("k", F.array("k", "user_id").alias("list")).alias("extra")))
    text = F.to_json(F.struct(F.lit("n/a").alias("value"), F.struct("k").alias("extra")))
    shaped = F.when(F.col("zone") == "view", flat).when(F.col("zone") == "click", text).otherwise(nested)
    line = F.when(F.col("k") == 13, F.lit('{"value": ')).otherwise(shaped)
    return payloads.parse_payloads(t.readings.select("event_id", "zone", line.alias("payload")), "payload")


@query(
    "s10_open_fields",
    """SELECT event_id, zone, CASE WHEN zone <> 'click' AND k <> 13 THEN whole END AS value, CASE WHEN zone <> 'view' AND k <> 13 THEN k END AS k FROM readings""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    """Fields by path from payloads of different shapes."""
    found = payloads.payload_fields(open_payloads(t), "payload_value", {"value": ("$.value", "bigint"), "k": ("$.extra.k", "int")})
    return found.drop("payload")


@query(
    "s10_payload_shapes",
    """SELECT zone, CASE WHEN count(*) FILTER (k <> 13) = 0 THEN 'VOID' WHEN zone = 'view' THEN 'OBJECT<value: BIGINT>' WHEN zone = 'click' THEN 'OBJECT<extra: OBJECT<k: BIGINT>, value: STRING>'
  ELSE 'OBJECT<extra: OBJECT<k: BIGINT, list: ARRAY<BIGINT>>, value: BIGINT>' END AS shape, count(*) FILTER (k <> 13) AS readable FROM readings GROUP BY zone""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    """The schema of each zone's payloads, found from all of them."""
    return payloads.payload_shapes(open_payloads(t), "payload_value", ["zone"])


@query(
    "s10_payload_elements",
    """SELECT event_id, 0 AS position, CAST(k AS BIGINT) AS element FROM readings WHERE zone NOT IN ('view', 'click') AND k <> 13
UNION ALL SELECT event_id, 1, user_id FROM readings WHERE zone NOT IN ('view', 'click') AND k <> 13""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    rows = payloads.payload_elements(open_payloads(t), "payload_value", "$.extra.list")
    return rows.select("event_id", "position", F.col("element").cast("bigint").alias("element"))


@query(
    "q3_payload_paths",
    f"""SELECT zone, 'missing $.extra.k' AS issue, count(*) AS payloads FROM readings WHERE zone = 'view' AND k <> 13 GROUP BY zone
UNION ALL SELECT zone, 'missing $.extra.list', count(*) FROM readings WHERE zone IN ('view', 'click') AND k <> 13 GROUP BY zone
UNION ALL SELECT zone, '{payloads.UNREADABLE}', count(*) FROM readings WHERE k = 13 GROUP BY zone""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return payloads.path_issues(open_payloads(t), "payload_value", ["$.value", "$.extra.k", "$.extra.list"], ["zone"])


@query(
    "s6_bucketed_join",
    f"SELECT zone, datetime, {CI}, temperature_2m_c FROM observed JOIN weather USING (zone, datetime)",
    ctes="observed weather",
)
def _(t: Tables) -> DataFrame:
    """The inner join of two stored tables whose buckets lie side by side, without an exchange."""
    keys, buckets = ["zone", "datetime"], 32
    sides = [
        tables.write_bucketed(rows, f"{label}_{uuid.uuid4().hex}", scratch_path(t.spark, label), keys, buckets)
        for label, rows in (("grid", t.grid_observed.select(*keys, CI)), ("weather", t.weather.select(*keys, "temperature_2m_c")))
    ]
    return sides[0].hint("merge").join(sides[1], keys)
