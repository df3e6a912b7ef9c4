"""Payloads of unknown shape, and joins of bucketed tables."""

import uuid

from pyspark.sql import functions as F

from tidemark.sources import payloads, tables

LINES = [
    ("a", '{"v": 1, "list": [1, null, "x"]}'),
    ("a", '{"v": 2.5, "deep": {"w": true}}'),
    ("a", '{"v": null}'),
    ("b", "{cut"),
    ("b", ""),
    ("b", None),
    (None, '{"v": "text", "list": []}'),
]


def parsed(spark):
    return payloads.parse_payloads(spark.createDataFrame(LINES, "zone string, payload string"), "payload")


def test_shapes_are_merged_over_rows(spark):
    found = {r.zone: (r["shape"], r.readable) for r in payloads.payload_shapes(parsed(spark), "payload_value", ["zone"]).collect()}
    assert found["a"][0].startswith("OBJECT<deep: OBJECT<w: BOOLEAN>, list: ARRAY<VARIANT>, v: DECIMAL") and found["a"][1] == 3
    assert found["b"] == ("VOID", 0)
    assert found[None] == ("OBJECT<list: ARRAY<VOID>, v: STRING>", 1)


def test_fields_and_elements_by_path(spark):
    fields = payloads.payload_fields(parsed(spark), "payload_value", {"v": ("$.v", "double"), "w": ("$.deep.w", "boolean")})
    assert fields.columns == ["zone", "payload", "v", "w"]
    assert [(r.v, r.w) for r in fields.orderBy("v").collect() if r.v] == [(1.0, None), (2.5, True)]
    assert fields.count() == len(LINES)
    elements = payloads.payload_elements(parsed(spark), "payload_value", "$.list")
    got = elements.select("position", F.try_variant_get("element", "$", "string").alias("e")).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(0, "1"), (1, None), (2, "x")]


def test_missing_paths_are_counted(spark):
    found = payloads.path_issues(parsed(spark), "payload_value", ["$.v", "$.list"], ["zone"]).collect()
    assert sorted((str(r.zone), r.issue, r.payloads) for r in found) == [
        ("a", "missing $.list", 2),
        ("a", "missing $.v", 1),
        ("b", payloads.UNREADABLE, 3),
    ]
    assert payloads.path_issues(parsed(spark).limit(0), "payload_value", ["$.v"], ["zone"]).count() == 0


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    i = F.col("id")
    left = spark.range(3000).select(F.when(i % 5 != 0, i % 4).alias("zone"), (i % 300).alias("hour"), i.alias("l"))
    right = spark.range(2000).select((i % 4).alias("zone"), (i % 450).alias("hour"), i.alias("r"))
    stored = [
        tables.write_bucketed(df, f"side_{uuid.uuid4().hex}", str(tmp_path / n), ["zone", "hour"], 6, sort_by=[n])
        for n, df in (("l", left), ("r", right))
    ]
    joined = stored[0].hint("merge").join(stored[1], ["zone", "hour"])
    grouped = stored[0].groupBy("zone", "hour").agg(F.sum("l").alias("total"))
    for df in (joined, grouped):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, ["zone", "hour"]).collect()))
    assert grouped.count() == left.groupBy("zone", "hour").count().count()
