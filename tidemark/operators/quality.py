"""Schema gates, landing checks, named checks and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import buckets, parsing
from tidemark.operators.ranks import exact_quantiles
from tidemark.operators.profile import numeric_profile
from tidemark.session import written

ANOMALY_SCHEMA = "dataset string, column string, anomaly string, detail string, rows long"
PSI_FLOOR = 1e-6


def infer_baseline(df: DataFrame, open_columns: Sequence[str] = (), name: str = "") -> DataFrame:
    """Schema table: one row per column, plus one row per value of each text column.

    Every text column has a closed domain, whatever its size, unless it is declared open; an open
    column gets its schema row only and its values are not read.
    """
    spark = df.sparkSession
    columns = spark.createDataFrame(
        [(name, f.name, f.dataType.simpleString(), None) for f in df.schema.fields],
        "dataset string, column string, type string, value string",
    )
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in open_columns]
    if not text:
        return columns
    values = _text_values(df, text)
    return columns.unionByName(values.select(F.lit(name).alias("dataset"), "column", F.lit("string").alias("type"), "value"))


def _text_values(df: DataFrame, text: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in text])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def schema_anomalies(df: DataFrame, baseline: DataFrame, columns: Mapping[str, str], dataset: str = "") -> DataFrame:
    """Missing columns, changed types, unexpected text values, empty table.

    ``columns`` is the baseline's column -> type mapping; ``baseline`` its value rows.
    """
    spark = df.sparkSession
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    structural = []
    for column, kind in columns.items():
        if column not in actual:
            structural.append((dataset, column, "missing column", kind, None))
        elif actual[column] != kind:
            structural.append((dataset, column, "type changed", f"{kind} -> {actual[column]}", None))
    found = spark.createDataFrame(structural, ANOMALY_SCHEMA)
    empty = df.agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") == 0).select(
        F.lit(dataset).alias("dataset"),
        F.lit(None).cast("string").alias("column"),
        F.lit("empty table").alias("anomaly"),
        F.lit(None).cast("string").alias("detail"),
        "rows",
    )
    found = found.unionByName(empty)
    text = [c for c, kind in columns.items() if kind == "string" and actual.get(c) == "string"]
    if text:
        domain = baseline.filter(F.col("value").isNotNull()).select("column", "value")
        closed = domain.select("column").distinct()
        unexpected = (
            _text_values(df, text).join(closed, "column", "left_semi").join(domain, ["column", "value"], "left_anti")
        )
        found = found.unionByName(
            unexpected.select(
                F.lit(dataset).alias("dataset"),
                "column",
                F.lit("unexpected value").alias("anomaly"),
                F.col("value").alias("detail"),
                "rows",
            )
        )
    return found


def baseline_columns(baseline: DataFrame) -> dict[str, str]:
    """Column -> type of a stored baseline; a schema-sized read on the driver."""
    return {r["column"]: r["type"] for r in baseline.filter(F.col("value").isNull()).select("column", "type").collect()}


def schema_gate(
    datasets: Mapping[str, DataFrame | None],
    baselines: Mapping[str, DataFrame | None],
    strict: bool = False,
) -> DataFrame:
    """PASSED, FAILED or SKIPPED per dataset. A missing dataset or baseline is SKIPPED,
    or FAILED when ``strict``.
    """
    spark = SparkSession.active()
    absent = "FAILED" if strict else "SKIPPED"
    rows: DataFrame | None = None
    for name, df in datasets.items():
        baseline = baselines.get(name)
        if df is None or baseline is None:
            reason = "dataset missing" if df is None else "no baseline"
            one = spark.createDataFrame([(name, absent, reason, 0)], "dataset string, status string, detail string, anomalies long")
        else:
            anomalies = schema_anomalies(df, baseline, baseline_columns(baseline), name)
            one = anomalies.agg(F.count(F.lit(1)).alias("anomalies")).select(
                F.lit(name).alias("dataset"),
                F.when(F.col("anomalies") > 0, "FAILED").otherwise("PASSED").alias("status"),
                F.lit(None).cast("string").alias("detail"),
                "anomalies",
            )
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no datasets")
    return rows


def require_passed(gate: DataFrame) -> None:
    failed = [r["dataset"] for r in gate.filter(F.col("status") == "FAILED").select("dataset").collect()]
    if failed:
        raise ValueError(f"schema validation failed: {sorted(failed)}")


def run_checks(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Evaluate named checks in one aggregate.

    Each check is (passed, detail), both aggregate columns. A check whose condition is
    null does not pass.
    """
    aggregates = []
    for i, (passed, detail) in enumerate(checks.values()):
        aggregates += [F.coalesce(passed, F.lit(False)).alias(f"p{i}"), detail.cast("string").alias(f"d{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.col(f"p{i}").alias("passed"), F.col(f"d{i}").alias("detail"))
            for i, name in enumerate(checks)
        ]
    )
    return df.agg(*aggregates).select(F.inline(rows))


def all_between(column: str, low: float, high: float) -> tuple[Column, Column]:
    """Check: every value present and in [low, high]."""
    outside = F.count_if(~F.coalesce(F.col(column).between(low, high), F.lit(False)))
    return outside == 0, outside


def no_nulls(columns: Sequence[str]) -> tuple[Column, Column]:
    nulls = F.sum(sum((F.col(c).isNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNull().cast("int")))
    return nulls == 0, nulls


def rows_between(low: int, high: int) -> tuple[Column, Column]:
    n = F.count(F.lit(1))
    return (n > low) & (n < high), n


def distinct_count_is(column: str, expected: int) -> tuple[Column, Column]:
    n = F.count_distinct(column)
    return n == expected, n


def column_checks(df: DataFrame, required: Sequence[str], expected_count: int | None = None) -> list[tuple[str, bool, str]]:
    """Presence of columns and their number; needs only the schema."""
    results = [(f"has {c}", c in df.columns, "") for c in required]
    if expected_count is not None:
        results.append(("column count", len(df.columns) == expected_count, str(len(df.columns))))
    return results


def equal_rows_per_key(df: DataFrame, key: str = "zone") -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        (F.min("_n") == F.max("_n")).alias("passed"), F.min("_n").alias("fewest"), F.max("_n").alias("most")
    )


def file_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse raw text lines into a map of field -> text; unreadable lines get null."""
    text = F.trim(F.col(value))
    return lines.filter(text != "").withColumn("record", F.from_json(text, "map<string,string>"))


def grid_file_issues(
    records: DataFrame,
    expected: DataFrame,
    value_fields: Mapping[str, str] | None = None,
    min_records: int = 1,
    null_rate: float = 0.5,
    flows: str = "electricity-flows",
    mix: str = "electricity-mix",
) -> DataFrame:
    """Issues of the newest hourly file of every expected (zone, signal).

    ``records`` has zone, signal, file and record (see :func:`file_records`). Later
    checks of a file run only when the earlier ones leave it readable.
    """
    field = F.coalesce(
        *[F.when(F.col("signal") == s, F.lit(f)) for s, f in (value_fields or {}).items()], F.lit("value")
    )
    has = lambda name: F.max(F.coalesce(F.map_contains_key("record", name), F.lit(False)))
    ts = parsing.try_parse_utc(F.col("record")["datetime"])
    parsed = records.withColumn("_ts", ts).withColumn("_field", field)
    number = parsing.to_number(F.try_element_at("record", F.col("_field")))
    stats = parsed.groupBy("zone", "signal", "file").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("record").isNull()).alias("unreadable"),
        has(F.lit("datetime")).alias("has_datetime"),
        (has(F.lit("import")) | has(F.lit("export"))).alias("has_flow"),
        has(F.lit("mix")).alias("has_mix"),
        F.max(F.coalesce(F.map_contains_key("record", F.col("_field")), F.lit(False))).alias("has_value"),
        F.count_if(F.col("_ts").isNull()).alias("bad_datetimes"),
        F.avg(number.isNull().cast("int")).alias("null_rate"),
    )
    # Repeats: every missing time counts as the same time.
    repeats = (
        parsed.groupBy("zone", "signal", "file", "_ts")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("zone", "signal", "file")
        .agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    )
    keys = ["zone", "signal", "file"]
    newest = stats.groupBy("zone", "signal").agg(F.max("file").alias("file"))
    latest = stats.join(newest, keys).join(repeats, keys)
    joined = expected.join(latest, ["zone", "signal"], "left")

    scalar = ~F.col("signal").isin(flows, mix)
    broken = (
        F.when(F.col("file").isNull(), "missing file")
        .when(F.col("unreadable") > 0, "unreadable file")
        .when(F.col("n") < min_records, "too few records")
        .when(~F.col("has_datetime"), "missing datetime")
        .when((F.col("signal") == flows) & ~F.col("has_flow"), "missing import/export")
        .when((F.col("signal") == mix) & ~F.col("has_mix"), "missing mix")
        .when(scalar & ~F.col("has_value"), "missing value field")
    )
    return _issue_rows(joined, ["zone", "signal", "file"], broken, scalar & (F.col("null_rate") > null_rate))


def weather_file_issues(
    rows: DataFrame,
    expected: DataFrame,
    features: Sequence[str],
    min_rows: int = 1,
    null_rate: float = 0.5,
    time: str = "time",
) -> DataFrame:
    """Issues of the newest hourly weather file of every expected location.

    ``rows`` has location, file and the CSV columns as text, plus ``_columns``: the
    header of the file as an array.
    """
    keys = ["location", "file"]
    parsed = rows.withColumn("_ts", parsing.try_parse_utc(F.col(time)))
    required = F.array(*[F.lit(c) for c in [time, *features]])
    rates = [F.avg(parsing.to_number(F.col(c)).isNull().cast("int")) for c in features]
    stats = parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.size(F.array_except(required, F.col("_columns")))).alias("missing"),
        F.count_if(F.col("_ts").isNull()).alias("bad_datetimes"),
        (F.greatest(*rates) if len(rates) > 1 else rates[0]).alias("null_rate"),
    )
    repeats = (
        parsed.groupBy(*keys, "_ts")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys)
        .agg(F.sum(F.col("_n") - 1).alias("duplicates"))
    )
    newest = stats.groupBy("location").agg(F.max("file").alias("file"))
    joined = expected.join(stats.join(newest, keys).join(repeats, keys), ["location"], "left")
    broken = (
        F.when(F.col("file").isNull(), "missing file")
        .when(F.col("n") < min_rows, "too few records")
        .when(F.col("missing") > 0, "missing columns")
    )
    return _issue_rows(joined, keys, broken, F.col("null_rate") > null_rate)


def _issue_rows(files: DataFrame, keys: Sequence[str], broken: Column, high_nulls: Column) -> DataFrame:
    intact = broken.isNull()

    def issue(condition: Column, text: str, size: Column) -> Column:
        return F.when(intact & condition, F.struct(F.lit(text).alias("issue"), size.cast("double").alias("size")))

    issues = F.array_compact(
        F.array(
            F.when(broken.isNotNull(), F.struct(broken.alias("issue"), F.lit(None).cast("double").alias("size"))),
            issue(F.col("bad_datetimes") > 0, "bad datetimes", F.col("bad_datetimes")),
            issue(F.col("duplicates") > 0, "duplicate datetimes", F.col("duplicates")),
            issue(high_nulls, "high null rate", F.col("null_rate")),
        )
    )
    return files.select(*keys, F.inline(issues))


def require_no_issues(issues: DataFrame) -> None:
    """Fail the run when there is any issue; a few are quoted."""
    sample = issues.limit(20).collect()
    if sample:
        raise RuntimeError("hourly checks failed:\n" + "\n".join(str(r.asDict()) for r in sample))


def drift_table(current: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Differences of mean, deviation, null share and quartiles per column; both sides in one grouped pass."""
    measures = ["mean", "std", "p25", "median", "p75"]
    sides = {"baseline": baseline, "current": current}
    both = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("side"), *columns) for n, df in sides.items()])
    table = numeric_profile(both, columns, by=["side"])
    rate = F.col("nulls") / (F.col("nulls") + F.col("count"))
    wide = table.withColumn("null_rate", rate).groupBy("column").agg(
        *[F.max(F.when(F.col("side") == n, F.col(m))).alias(f"{n}_{m}") for n in sides for m in [*measures, "null_rate"]]
    )
    return wide.withColumns(
        {f"{m}_change": F.col(f"current_{m}") - F.col(f"baseline_{m}") for m in [*measures, "null_rate"]}
    )


def drift_flag(drift: DataFrame, limit: float = 0.5) -> DataFrame:
    """drift_detected: whether any column's mean moved by more than ``limit`` baseline deviations."""
    moved = F.abs(F.col("mean_change")) > F.lit(limit) * F.col("baseline_std")
    return drift.agg(F.coalesce(F.bool_or(moved), F.lit(False)).alias("drift_detected"))


def population_stability(current: DataFrame, baseline: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per column over the baseline's quantile bins.

    Both sides are reduced once to counted values; edges, shares and totals come from that table.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    sides = [df.select(F.lit(n).alias("side"), F.inline(pairs)) for n, df in (("_p", baseline), ("_q", current))]
    counted = written(
        reduce(DataFrame.unionByName, sides).filter(F.col("value").isNotNull()).groupBy("side", "feature", "value").agg(F.count(F.lit(1)).alias("times")),
        "stability",
    )
    base = counted.filter(F.col("side") == "_p")
    cuts = exact_quantiles(base, ["feature"], "value", [i / bins for i in range(1, bins)], weight="times")
    # features x (bins - 1) values.
    edges = cuts.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("_edges"))
    index = F.size(F.filter("_edges", lambda e: e < F.col("value")))
    binned = counted.join(F.broadcast(edges), "feature").groupBy("feature", index.alias("bin")).agg(
        *[F.sum(F.when(F.col("side") == s, F.col("times"))).alias(f"{s}_n") for s in ("_p", "_q")]
    )
    whole = Window.partitionBy("feature")
    # features x bins rows.
    both = binned.select("feature", "bin", *[(F.col(f"{s}_n") / F.sum(f"{s}_n").over(whole)).alias(s) for s in ("_p", "_q")])
    p = F.greatest(F.coalesce("_p", F.lit(0.0)), F.lit(PSI_FLOOR))
    q = F.greatest(F.coalesce("_q", F.lit(0.0)), F.lit(PSI_FLOOR))
    return (
        both.groupBy("feature")
        .agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
        .withColumn("status", buckets.change_status(F.col("psi")))
        .withColumn("action", F.when(F.col("status") == "Warning", "Retrain recommended").otherwise("-"))
    )
