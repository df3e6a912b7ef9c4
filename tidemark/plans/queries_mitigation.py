"""Queries of the mitigation run: balanced training rows, both versions per slice, the verdict."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import decisions, mitigation
from tidemark.plans.canonical import GRID_VALUES, WEATHER_VALUES, Tables
from tidemark.plans.queries_live import FIT_ROWS, FIRST, MODEL_SQL, SMALL, TARGETS, divided, fitted, matrix_columns, model_table, written
from tidemark.plans.registry import query

CI = GRID_VALUES[0]
HORIZON = 12
FAVOURED = "purchase"
NOISY = [*GRID_VALUES[1:], *WEATHER_VALUES]
KEPT = ["zone", "datetime", "temperature_2m_c", "wind_speed_100m_ms", "cloud_cover_pct"]


def balanced(t: Tables) -> DataFrame:
    train, _val, _test = divided(model_table(t))
    return mitigation.balanced_rows(train, CI, NOISY, "zone", FAVOURED)


@query(
    "m13_balanced_rows",
    f"""WITH train AS (SELECT * FROM merged WHERE datetime <= TIMESTAMP '{FIRST}'), rare AS (SELECT count(*) AS n FROM train WHERE {CI} < 100)
SELECT false AS is_synthetic, CASE WHEN zone = '{FAVOURED}' THEN {mitigation.ZONE_FACTOR} ELSE 1.0 END::DOUBLE AS weight, count(*) AS rows FROM train GROUP BY 1, 2
UNION ALL SELECT true, 1.0, {mitigation.RARE_ROWS} - n FROM rare WHERE n BETWEEN 1 AND {mitigation.RARE_ROWS - 1}""",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Training rows and copies by weight."""
    return balanced(t).groupBy("is_synthetic", F.col(mitigation.WEIGHT).alias("weight")).agg(F.count(F.lit(1)).alias("rows"))


def versions(t: Tables) -> DataFrame:
    """Predictions of the model in use and of the one fitted on balanced rows, for every test row; written once."""
    models, (train, val, test) = fitted(t)
    label = TARGETS[HORIZON]

    def fit(path: str) -> None:
        mitigation.refit(balanced(t), val, matrix_columns(train), label, SMALL, FIT_ROWS).write().save(path)

    new = PipelineModel.load(written(t, "mitigated", fit))
    return mitigation.paired_predictions(models[HORIZON], new, test, KEPT, label, HORIZON)


@query(
    "m13_mitigation_run",
    f"""{MODEL_SQL}, t AS (SELECT * FROM long WHERE split = 'test' AND horizon_hours = {HORIZON} AND actual IS NOT NULL)
SELECT 'zone' AS slice_type, zone AS slice_value, count(*) AS n_samples, true AS compared FROM t GROUP BY zone HAVING count(*) >= 10
UNION ALL SELECT 'overall', 'all', count(*), true FROM t HAVING count(*) >= 10""",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Weights and noisy copies, fitted again, both versions compared per zone and overall."""
    report = mitigation.mitigation_report(versions(t)).filter(F.col("slice_type").isin("zone", "overall"))
    compared = F.col("mae_improvement").isNotNull() & (F.col("mae_before") >= 0) & (F.col("mae_after") >= 0)
    return report.select("slice_type", "slice_value", "n_samples", compared.alias("compared"))


@query("m14_retrained_decision")
def _(t: Tables) -> DataFrame:
    """Whether the version fitted on balanced rows may replace the one in use, from their scores on all test rows."""
    return decisions.promotion_decision(mitigation.retrained_verdicts(versions(t)))
