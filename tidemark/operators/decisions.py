"""Comparing, promoting and monitoring models from their metric tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import buckets, scalars
from tidemark.operators.series import Series, dense, islands

# Promotion and alert limits.
IMPROVEMENT_THRESHOLD = 0.005
REGRESSION_TOLERANCE = 0.010
R2_MIN_DROP = 0.02
ALERT_RULES = (
    # name, metric, comparison, limit, seconds it must hold, severity
    ("ModelDecayWarning", "mae_pct_change", ">", 0.20, 300, "warning"),
    ("ModelDecayCritical", "mae_pct_change", ">", 0.35, 120, "critical"),
    ("DataDriftDetected", "drift_detected", "=", 1.0, 60, "critical"),
    ("BiasCheckFailed", "bias_critical_count", ">", 0.0, 60, "warning"),
)


def compare_slices(before: DataFrame, after: DataFrame, by: Sequence[str] = ("slice_type", "slice_value")) -> DataFrame:
    """Error before and after a change per slice; slices on one side only stay in."""
    left = before.select(*by, F.col("mae").alias("mae_before"), F.col("r2").alias("r2_before"))
    right = after.select(*by, F.col("mae").alias("mae_after"), F.col("r2").alias("r2_after"))
    gain = F.col("mae_before") - F.col("mae_after")
    return left.join(right, list(by), "full").withColumns(
        {
            "mae_improvement": gain,
            "mae_improvement_pct": scalars.half_even(gain / F.nullif(F.col("mae_before"), F.lit(0.0)) * 100, 2),
        }
    )


def mean_improvement(comparison: DataFrame, kinds: Sequence[str] = ("zone", "carbon_bucket"), by: Sequence[str] = ()) -> DataFrame:
    return comparison.filter(F.col("slice_type").isin(*kinds)).groupBy(*by).agg(
        scalars.half_even(F.avg("mae_improvement_pct"), 4).alias("avg_improvement_pct")
    )


def metric_log(comparison: DataFrame) -> DataFrame:
    """Long (metric, value) rows with cleaned metric names."""
    key = scalars.metric_key(F.col("slice_type"), F.col("slice_value"))
    measures = {"mae_before": "mae_before", "mae_after": "mae_after", "improvement_pct": "mae_improvement_pct"}
    pairs = F.array(
        *[F.struct(F.concat(key, F.lit(f"__{name}")).alias("metric"), F.col(c).alias("value")) for name, c in measures.items()]
    )
    return comparison.select(F.inline(pairs))


def promotion_verdicts(
    new: DataFrame,
    current: DataFrame,
    by: Sequence[str] = ("horizon",),
    improvement: float = IMPROVEMENT_THRESHOLD,
    tolerance: float = REGRESSION_TOLERANCE,
    r2_drop: float = R2_MIN_DROP,
) -> DataFrame:
    """improved, neutral or regressed per horizon; a horizon without a current model is improved."""
    running = current.select(*by, *[F.col(m).alias(f"{m}_current") for m in ("mae", "rmse", "r2")], F.lit(True).alias("_known"))
    fresh = new.select(*by, *[F.col(m).alias(f"{m}_new") for m in ("mae", "rmse", "r2")])
    joined = fresh.join(running, list(by), "left")
    delta = F.col("mae_new") - F.col("mae_current")
    share = F.coalesce(delta / F.nullif(F.col("mae_current"), F.lit(0.0)), F.when(F.col("mae_current") == 0, 0.0))
    r2_delta = F.col("r2_new") - F.col("r2_current")
    violated = F.coalesce(r2_delta < -r2_drop, F.lit(False))
    known = F.coalesce(F.col("_known"), F.lit(False))
    verdict = (
        F.when(~known, "improved")
        .when((share <= -improvement) & ~violated, "improved")
        .when((share <= tolerance) & ~violated, "neutral")
        .otherwise("regressed")
    )
    return joined.select(
        *by,
        verdict.alias("verdict"),
        scalars.half_even(F.col("mae_current"), 4).alias("mae_current"),
        scalars.half_even(F.col("mae_new"), 4).alias("mae_new"),
        scalars.half_even(delta, 4).alias("mae_delta"),
        scalars.half_even(share * 100, 3).alias("mae_pct"),
        scalars.half_even(F.col("rmse_new") - F.col("rmse_current"), 4).alias("rmse_delta"),
        scalars.half_even(r2_delta, 4).alias("r2_delta"),
        violated.alias("r2_violated"),
    )


def promotion_decision(verdicts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """promote unless any horizon regressed."""
    counts = verdicts.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("improved", "neutral", "regressed")])
    return counts.withColumn("decision", F.when(F.col("regressed") == 0, "promote").otherwise("reject"))


def mae_change(current: DataFrame, baseline: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Relative change of the error against the baseline; baselines of zero are left out."""
    base = baseline.select(*by, F.col("mae").alias("baseline_mae")).filter(F.col("baseline_mae") > 0)
    return current.select(*by, "mae").join(base, list(by)).withColumn(
        "pct_change", (F.col("mae") - F.col("baseline_mae")) / F.col("baseline_mae")
    )


def improvement_report(scored: DataFrame, baseline: DataFrame, by: Sequence[str] = ("horizon",)) -> DataFrame:
    """Gain over the baseline in percent and the quality tier."""
    base = baseline.select(*by, F.col("mae").alias("baseline_mae"))
    return scored.select(*by, "mae").join(base, list(by), "left").withColumns(
        {
            "mae_improvement_pct": buckets.improvement_pct(F.col("baseline_mae"), F.col("mae")),
            "tier": buckets.performance_tier(F.col("mae"), F.col("baseline_mae")),
        }
    )


def rollback_target(
    audit: DataFrame, versions: DataFrame | None = None, model: str = "model_type", min_history: int = 2
) -> DataFrame:
    """Version to return to and version in use, per model.

    The last two successful promotions decide when they differ; else the newest
    version that is not the one in production.
    """
    done = audit.filter(
        F.col("event").isin("promote", "rollback")
        & F.col("status").isin("success", "partial")
        & (F.coalesce(F.col("version"), F.lit("")) != "")
    )
    newest = Window.partitionBy(model).orderBy(F.col("logged_at").desc(), F.col("entry").desc())
    last_two = done.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= max(2, min_history))
    from_log = (
        last_two.groupBy(model)
        .agg(
            F.max(F.when(F.col("_r") == 2, F.col("version"))).alias("target_version"),
            F.max(F.when(F.col("_r") == 1, F.col("version"))).alias("current_version"),
            F.count(F.lit(1)).alias("_known"),
        )
        .filter((F.col("_known") >= min_history) & (F.col("target_version") != F.col("current_version")))
        .select(model, "target_version", "current_version", F.lit("audit_log").alias("source"))
    )
    if versions is None:
        return from_log
    # All newest-first picks are aggregates with partial reduction.
    order = F.struct("created_at", "version")
    production = versions.groupBy(model).agg(F.max_by("version", F.when(F.col("is_production"), order)).alias("current_version"))
    others = versions.join(production, model).filter(F.col("version") != F.col("current_version"))
    from_versions = others.groupBy(model, "current_version").agg(F.max_by("version", order).alias("target_version"))
    fallback = from_versions.join(from_log, model, "left_anti").select(
        model, "target_version", "current_version", F.lit("version_history").alias("source")
    )
    return from_log.unionByName(fallback)


def newest_entries(df: DataFrame, limit: int, order: Sequence[str | Column]) -> DataFrame:
    """Newest rows first, at most ``limit`` (the report's length)."""
    return df.orderBy(*[c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order]).limit(limit)


def best_run(runs: DataFrame, by: Sequence[str] = ("horizon",), metric: str = "test_mae", model_type: str | None = None) -> DataFrame:
    """Run with the smallest metric per horizon."""
    chosen = runs.filter(F.col("model_type") == model_type) if model_type else runs
    order = Window.partitionBy(*by).orderBy(F.col(metric).asc_nulls_last(), "run_id")
    return chosen.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") == 1).drop("_r")


def newest_version(versions: DataFrame, by: Sequence[str] = ("model_type",)) -> DataFrame:
    return versions.groupBy(*by).agg(
        F.max_by("version", F.struct("created_at", "version")).alias("version"), F.max("created_at").alias("created_at")
    )


def run_table(runs: DataFrame, tags: Mapping[str, str], metrics: Sequence[str]) -> DataFrame:
    """Flat columns from a run's tag map (name -> default) and metric map."""
    return runs.select(
        "run_id",
        *[F.coalesce(F.try_element_at("tags", F.lit(t)), F.lit(d)).alias(t) for t, d in tags.items()],
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics],
    )


def standard_metrics(runs: DataFrame) -> DataFrame:
    """mae, rmse, r2 and mape of a run: the test value, else the plain one."""
    return runs.select(
        "run_id", *[scalars.first_metric(F.col("metrics"), f"test_{m}", m).alias(m) for m in ("mae", "rmse", "r2", "mape")]
    )


def alert_intervals(samples: DataFrame, rules=ALERT_RULES, keys: Sequence[str] = ("metric", "label"), time: str = "ts", step_seconds: int = 60) -> DataFrame:
    """Times a rule's condition held without a break for at least its duration.

    Samples are (metric, label, ts, value). Neighbouring samples of a metric count as
    unbroken.
    """
    spark = samples.sparkSession
    table = spark.createDataFrame(
        list(rules), "rule string, metric string, comparison string, limit double, hold_seconds long, severity string"
    )
    # The rule list is a handful of rows.
    judged = samples.join(F.broadcast(table), "metric").withColumn(
        "_bad",
        F.when(F.col("comparison") == ">", F.col("value") > F.col("limit")).otherwise(F.col("value") == F.col("limit")),
    )
    series = Series(keys=("rule", *keys), time=time, step_seconds=step_seconds)
    positioned, counted = dense(judged, series)
    marked = islands(positioned, counted, F.col("_bad"))
    spans = (
        marked.filter(F.col("_island").isNotNull())
        .groupBy("rule", *keys, "severity", "hold_seconds", F.col("_island").alias("started_at"))
        .agg(F.max(time).alias("last_seen"), F.max("value").alias("worst_value"))
    )
    held = (F.unix_micros("last_seen") - F.unix_micros("started_at")) / 1_000_000
    return spans.filter(held >= F.col("hold_seconds")).drop("hold_seconds")


def metric_table(now: Column, scored: DataFrame, changes: DataFrame, drift: DataFrame, critical: DataFrame) -> DataFrame:
    """All monitored values as (ts, metric, label, value) rows."""
    parts = [
        scored.select(
            F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col("horizon").cast("string").alias("label"), F.col(m).alias("value")) for m in ("mae", "rmse", "r2")]))
        ),
        changes.select(F.lit("mae_pct_change").alias("metric"), F.col("horizon").cast("string").alias("label"), F.col("pct_change").alias("value")),
        drift.select(F.lit("drift_detected").alias("metric"), F.lit("all").alias("label"), F.col("drift_detected").cast("double").alias("value")),
        critical.select(F.lit("bias_critical_count").alias("metric"), F.lit("all").alias("label"), F.col("critical").cast("double").alias("value")),
    ]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.select(now.alias("ts"), "metric", "label", "value")


def evaluate_rules(metrics: DataFrame, rules=ALERT_RULES) -> DataFrame:
    """Rules whose condition holds on the current metric values."""
    cases = [
        F.when(
            (F.col("metric") == metric) & ((F.col("value") > limit) if op == ">" else (F.col("value") == limit)),
            F.struct(F.lit(name).alias("rule"), F.lit(level).alias("severity")),
        )
        for name, metric, op, limit, _, level in rules
    ]
    return metrics.select("metric", "label", "value", F.inline(F.array_compact(F.array(*cases))))
