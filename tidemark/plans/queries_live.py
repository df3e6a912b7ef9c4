"""Queries that run a stream over landed files, and queries that fit models."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import half_even
from tidemark.functions import buckets, parsing
from tidemark.operators import attribution, features, metrics, model, quality, tuning
from tidemark.operators.series import latest_rows
from tidemark.plans.canonical import GRID_VALUES, HOURLY, ZONES, Tables
from tidemark.plans.queries_reports import TARGETS
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.session import written as kept
from tidemark.sources import deliveries, tables
from tidemark.streaming import alerts, hourly, live

CI, LOAD = GRID_VALUES[0], GRID_VALUES[4]
READING_SCHEMA = "zone string, signal string, datetime string, value double"


def land(t: Tables, rows: DataFrame, path: str) -> None:
    """Append readings to a landing folder as JSON lines."""
    rows.select(
        "zone",
        F.lit("carbon-intensity").alias("signal"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("datetime"),
        F.col("whole").cast("double").alias("value"),
    ).write.mode("append").json(path)


def landed_stream(t: Tables, path: str) -> DataFrame:
    return hourly.parse_readings(hourly.read_landing_stream(t.spark, path, READING_SCHEMA))


def streamed(t: Tables, stream: DataFrame) -> DataFrame:
    """Run the stream over all that has landed and return the written table."""
    out = scratch_path(t.spark, "stream")
    hourly.write_available(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}/table")


@query("x1_landing_stream", "SELECT zone, 'carbon-intensity' AS signal, ts AS datetime, CAST(whole AS DOUBLE) AS value FROM readings", ctes="readings")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "landing")
    land(t, t.readings, path)
    return streamed(t, landed_stream(t, path))


@query("x2_first_delivery", "SELECT DISTINCT zone, 'carbon-intensity' AS signal, ts AS datetime, CAST(whole AS DOUBLE) AS value FROM readings", ctes="readings")
def _(t: Tables) -> DataFrame:
    """Part of the readings is delivered twice."""
    path = scratch_path(t.spark, "landing")
    land(t, t.readings, path)
    land(t, t.readings.filter(F.col("k") < 50), path)
    return streamed(t, hourly.first_delivery(landed_stream(t, path)))


@query(
    "x3_hourly_stream",
    """SELECT zone, datetime, count(*) AS readings, CAST(sum(whole) AS DOUBLE) AS total FROM readings
WHERE datetime + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM readings) GROUP BY zone, datetime""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "landing")
    land(t, t.readings, path)
    return streamed(t, hourly.hourly_values(landed_stream(t, path)))


@query(
    "x4_rolling_stream",
    """SELECT hours, zone, window_end, count(*) AS readings, avg(whole) AS mean, stddev_samp(whole) AS std, CAST(min(whole) AS DOUBLE) AS min, CAST(max(whole) AS DOUBLE) AS max
FROM (SELECT n.hours, zone, whole, datetime + to_hours(CAST(h AS INTEGER)) AS window_end FROM (VALUES (4), (12), (24)) n(hours), readings, generate_series(1, 24) g(h) WHERE h <= n.hours)
WHERE window_end <= (SELECT max(ts) - INTERVAL 2 HOUR FROM readings) GROUP BY hours, zone, window_end""",
    floats="mean std",
    digits=5,
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "landing")
    land(t, t.readings, path)
    parts = [streamed(t, hourly.rolling_values(landed_stream(t, path), n)).select(F.lit(n).alias("hours"), "*") for n in (4, 12, 24)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@contextmanager
def rocksdb(spark):
    """Keyed state needs the RocksDB store; the session's choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, live.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


LIVE_COLUMNS = [f.name for f in live.OUTPUT.fields if f.name != "status"]
_W = "OVER (PARTITION BY zone ORDER BY datetime"
# Held back until a later batch: one hour within the lateness, one beyond it.
SECOND_BATCH, THIRD_BATCH = "2024-01-15 00:00:00", "2024-01-20 00:00:00"
IN_TIME, TOO_LATE = "2024-01-14 05:00:00", "2024-01-10 05:00:00"


def run_live(t: Tables) -> DataFrame:
    """All rows that three batches write: two bring late hours, one an hour of the far future."""
    out = scratch_path(t.spark, "live")
    hours = t.grid_observed.select("zone", "datetime", F.col(CI).alias("value"))
    at = {name: F.lit(name).cast("timestamp") for name in (SECOND_BATCH, THIRD_BATCH, IN_TIME, TOO_LATE)}
    ts = F.col("datetime")
    arrives = (
        F.when(ts == at[IN_TIME], 2).when(ts == at[TOO_LATE], 3).when(ts < at[SECOND_BATCH], 1).when(ts < at[THIRD_BATCH], 2).otherwise(3)
    )
    future = hours.select("zone", F.lit("2199-01-01").cast("timestamp").alias("datetime"), F.lit(1.0).alias("value")).distinct()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")

    for n in (1, 2, 3):
        part = hours.filter(arrives == n)
        (part.unionByName(future) if n == 2 else part).write.mode("append").parquet(f"{out}/hours")
        with rocksdb(t.spark):
            stream = t.spark.readStream.schema("zone string, datetime timestamp, value double").parquet(f"{out}/hours")
            running = (
                live.live_features(stream)
                .writeStream.foreachBatch(write)
                .outputMode("update")
                .option("checkpointLocation", f"{out}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            running.awaitTermination()
    return t.spark.read.parquet(f"{out}/table")


@query(
    "x5_live_features",
    """SELECT * FROM (SELECT zone, datetime, v AS value, """
    + ", ".join(f"lag(v, {n}) {_W}) AS lag_{n}h" for n in live.LAGS)
    + ", "
    + ", ".join(f"avg(v) {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS rolling_mean_{n}h" for n in live.WINDOWS)
    + f""", stddev_samp(v) {_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rolling_std_24h, v - lag(v) {_W}) AS carbon_change_1h
FROM (SELECT zone, datetime, CASE WHEN datetime <> TIMESTAMP '{TOO_LATE}' THEN {CI} END AS v FROM axis)) WHERE value IS NOT NULL""",
    floats="rolling_mean_4h rolling_mean_12h rolling_mean_24h rolling_std_24h",
    digits=5,
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    return live.newest_rows(run_live(t)).select(*LIVE_COLUMNS)


@query(
    "x5_hours_not_taken",
    f"""SELECT zone, count(*) FILTER (datetime = TIMESTAMP '{TOO_LATE}') AS late, 1::BIGINT AS ahead FROM observed GROUP BY zone""",
    ctes="observed",
)
def _(t: Tables) -> DataFrame:
    return run_live(t).groupBy("zone").agg(*[F.count_if(F.col("status") == s).alias(s) for s in (live.LATE, live.AHEAD)])


@query(
    "x5_from_batch_table",
    """SELECT * FROM (SELECT zone, datetime, v AS value, """
    + ", ".join(f"lag(v, {n}) {_W}) AS lag_{n}h" for n in live.LAGS)
    + ", "
    + ", ".join(f"avg(v) {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS rolling_mean_{n}h" for n in live.WINDOWS)
    + f""", stddev_samp(v) {_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS rolling_std_24h, v - lag(v) {_W}) AS carbon_change_1h
FROM (SELECT zone, datetime, {CI} AS v FROM axis)) WHERE value IS NOT NULL AND datetime >= TIMESTAMP '{SECOND_BATCH}'""",
    floats="rolling_mean_4h rolling_mean_12h rolling_mean_24h rolling_std_24h",
    digits=5,
    ctes="axis",
)
def _(t: Tables) -> DataFrame:
    """A stream that starts from the last hours of a batch table knows them as if it had read them."""
    out = scratch_path(t.spark, "live-tail")
    hours = t.grid_observed.select("zone", "datetime", F.col(CI).alias("value"))
    early = F.col("datetime") < F.lit(SECOND_BATCH).cast("timestamp")
    hours.filter(early).write.parquet(f"{out}/history")
    hours.filter(~early).write.parquet(f"{out}/hours")
    with rocksdb(t.spark):
        stream = t.spark.readStream.schema("zone string, datetime timestamp, value double").parquet(f"{out}/hours")
        running = (
            live.live_features(stream, t.spark.read.parquet(f"{out}/history"))
            .writeStream.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}"))
            .outputMode("update")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    return live.newest_rows(t.spark.read.parquet(f"{out}/table")).select(*LIVE_COLUMNS)


@query(
    "x6_gated_batches",
    f"""WITH l AS (SELECT zone, date_trunc('day', datetime) AS day, CASE WHEN k <> 13 THEN datetime END AS dt, CASE WHEN k >= 30 THEN whole END AS v FROM readings),
s AS (SELECT zone, day, count(*) AS n, count(*) FILTER (dt IS NULL) AS bad, avg(CAST(v IS NULL AS INTEGER)) AS rate FROM l GROUP BY ALL),
r AS (SELECT zone, day, sum(c - 1) AS dup FROM (SELECT zone, day, dt, count(*) AS c FROM l GROUP BY ALL) GROUP BY ALL),
i AS (SELECT *, CAST(bad > 0 AS INTEGER) + CAST(dup > 0 AS INTEGER) + CAST(rate > 0.5 AS INTEGER) AS issues FROM s JOIN r USING (zone, day))
SELECT zone, CASE WHEN issues = 0 THEN 'good' ELSE 'quarantine' END AS outcome, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(issues) AS BIGINT) AS issues FROM i GROUP BY 1, 2""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    """Each micro-batch runs the landing checks; files with an issue are quarantined, issues go to a table."""
    out = scratch_path(t.spark, "gate")
    record = F.struct(
        F.when(F.col("k") == 13, "yesterday").otherwise(parsing.format_iso_z(F.col("datetime"))).alias("datetime"),
        F.when(F.col("k") < 30, "n/a").otherwise(F.col("whole").cast("string")).alias("value"),
    )
    t.readings.select("zone", F.date_format("datetime", "yyyyMMdd").alias("file"), F.to_json(record).alias("value")).write.json(f"{out}/landing")
    lines = t.spark.readStream.schema("zone string, file string, value string").json(f"{out}/landing")
    records = quality.file_records(lines.withColumn("signal", F.concat(F.lit("day-"), "file")))

    def check(batch: DataFrame) -> DataFrame:
        return quality.grid_file_issues(batch.select("zone", "signal", "file", "record"), batch.select("zone", "signal").distinct())

    hourly.gate_files(records, check, ["zone", "signal", "file"], f"{out}/good", f"{out}/quarantine", f"{out}/issues", f"{out}/checkpoint").awaitTermination()
    counts = [t.spark.read.parquet(f"{out}/{p}").groupBy("zone").agg(F.lit(p).alias("outcome"), F.count(F.lit(1)).alias("rows")) for p in ("good", "quarantine")]
    issues = t.spark.read.parquet(f"{out}/issues").groupBy("zone").agg(F.count(F.lit(1)).alias("issues")).withColumn("outcome", F.lit("quarantine"))
    return counts[0].unionByName(counts[1]).join(issues, ["zone", "outcome"], "left").fillna(0, ["issues"])


@query(
    "x7_violation_sessions",
    """WITH s AS (SELECT zone, ts, max(whole) AS v FROM readings GROUP BY zone, ts),
p AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY ts) AS pos, max(ts) OVER (PARTITION BY zone) - INTERVAL 2 HOUR AS judged FROM s),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY zone ORDER BY ts) AS grp FROM p WHERE v >= 20 AND ts <= judged),
e AS (SELECT zone, max(ts) AS last_good FROM p WHERE v < 20 AND ts <= judged GROUP BY zone)
SELECT g.zone, min(ts) AS started_at, max(ts) AS last_seen, CAST(max(v) AS DOUBLE) AS worst_value FROM g JOIN e ON g.zone = e.zone
GROUP BY g.zone, grp HAVING epoch(max(ts)) - epoch(min(ts)) >= 1800 AND max(ts) < max(last_good)""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    """Ended runs of values of 20 or more that held for half an hour; a lower value ends a run."""
    path = scratch_path(t.spark, "landing")
    land(t, t.readings.groupBy("zone", "ts").agg(F.max("whole").alias("whole")), path)
    with rocksdb(t.spark):
        found = streamed(t, alerts.held_intervals(landed_stream(t, path), "zone", F.col("value") >= 20, 1800, 7200, "datetime"))
    return found.filter(F.col("status") == alerts.HELD).drop("status").withColumnRenamed("key", "zone")


@query(
    "x8_late_rows_backfilled",
    """SELECT zone, count(*) AS rows, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS backfilled FROM (SELECT DISTINCT zone, ts FROM readings) GROUP BY zone""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    """Early readings land after late ones: the watermark drops them and a backfill merges them."""
    out = scratch_path(t.spark, "late")
    border = F.lit("2024-01-10").cast("timestamp")
    table = f"{out}/table"
    for part in (F.col("ts") >= border, F.col("ts") < border):
        land(t, t.readings.filter(part), f"{out}/landing")
        stream = hourly.first_delivery(landed_stream(t, f"{out}/landing"))
        hourly.write_available(stream, table, f"{out}/checkpoint").awaitTermination()
    kept = t.spark.read.parquet(table).select("zone", "datetime")
    landed = t.spark.read.schema(READING_SCHEMA).json(f"{out}/landing")
    landed = landed.select("zone", parsing.try_parse_utc(F.col("datetime")).alias("datetime")).distinct()
    late = landed.join(kept, ["zone", "datetime"], "left_anti")
    merged = kept.withColumn("_late", F.lit(0)).unionByName(late.withColumn("_late", F.lit(1)))
    return merged.groupBy("zone").agg(F.count(F.lit(1)).alias("rows"), F.sum("_late").alias("backfilled"))


@query(
    "x8_corrections",
    """WITH first AS (SELECT zone, ts, max(whole)::DOUBLE AS v, min(k) AS k FROM readings GROUP BY zone, ts)
SELECT zone, ts AS datetime, CASE WHEN k < 50 THEN v + 1000 WHEN k < 80 THEN v + 5 ELSE v END AS value, CASE WHEN k < 50 THEN 3 WHEN k < 80 THEN 2 ELSE 1 END AS version FROM first""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    """Four deliveries: all rows, a correction, an older correction that comes late, and the first correction again."""
    out = scratch_path(t.spark, "corrections")
    first = t.readings.groupBy("zone", F.col("ts").alias("datetime")).agg(F.max("whole").cast("double").alias("v"), F.min("k").alias("k"))
    corrected = first.where("k < 50").selectExpr("zone", "datetime", "v + 1000 AS value", "3 AS version")
    landed = [
        first.selectExpr("zone", "datetime", "v AS value", "1 AS version"),
        corrected,
        first.where("k < 80").selectExpr("zone", "datetime", "v + 5 AS value", "2 AS version"),
        corrected,
    ]
    schema = "zone string, datetime timestamp, value double, version int"
    for rows in landed:
        rows.write.mode("append").parquet(f"{out}/landing")
        stream = t.spark.readStream.schema(schema).parquet(f"{out}/landing")
        deliveries.merge_available(stream, f"{out}/table", f"{out}/checkpoint", ["zone", "datetime"], "datetime", "version").awaitTermination()
    return deliveries.read_deliveries(t.spark, f"{out}/table", schema)


@query(
    "x9_stream_join",
    "SELECT zone, datetime, carbon_intensity_gco2_per_kwh, temperature_2m_c FROM observed JOIN weather USING (zone, datetime)",
    ctes="observed weather",
)
def _(t: Tables) -> DataFrame:
    out = scratch_path(t.spark, "join")
    t.grid_observed.select("zone", "datetime", CI).write.parquet(f"{out}/grid")
    t.weather.select("zone", "datetime", "temperature_2m_c").write.parquet(f"{out}/weather")
    grid = t.spark.readStream.schema(f"zone string, datetime timestamp, {CI} double").parquet(f"{out}/grid")
    weather = t.spark.readStream.schema("zone string, datetime timestamp, temperature_2m_c double").parquet(f"{out}/weather")
    return streamed(t, hourly.join_weather(grid, weather))


# --- models ------------------------------------------------------------------------------

# Few shallow trees: the queries show the flow, not the accuracy.
SMALL = model.TreeParams(trees=4, depth=3, step=0.3, subsample=1.0, columns=1.0)
FIT_ROWS = 2000
FIRST, SECOND = "2024-01-18", "2024-01-23"
MODEL_SQL = f"""WITH lab AS (SELECT zone, datetime, {', '.join(f'lead({CI}, {h}) OVER w AS t{h}' for h in TARGETS)}
  FROM merged WINDOW w AS (PARTITION BY zone ORDER BY datetime)),
part AS (SELECT *, CASE WHEN datetime <= TIMESTAMP '{FIRST}' THEN 'train' WHEN datetime <= TIMESTAMP '{SECOND}' THEN 'val' ELSE 'test' END AS split FROM lab),
long AS ({" UNION ALL ".join(f"SELECT zone, datetime, split, {h} AS horizon_hours, t{h} AS actual FROM part" for h in TARGETS)})"""


# Folders of the matrix and the models by application and state of the tables: the model queries of a run share them.
WRITTEN: dict[tuple, str] = {}


def table_state(t: Tables) -> tuple:
    """Number, bytes and newest change of the files that the series are read from, by a listing that reads no content."""
    files = t.spark.read.format("binaryFile").load(f"{t.sf_dir}/events.parquet")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.unix_micros(F.max("modificationTime"))).first())


def written(t: Tables, label: str, write) -> str:
    key = (t.spark.sparkContext.applicationId, t.sf_dir, table_state(t), label)
    if key not in WRITTEN:
        path = scratch_path(t.spark, label)
        write(path)
        WRITTEN[key] = path
    return WRITTEN[key]


def model_table(t: Tables) -> DataFrame:
    """The feature matrix with targets and weight, written once: training reads it many times."""
    return t.spark.read.parquet(written(t, "model_ready", lambda path: write_model_table(t, path)))


def write_model_table(t: Tables, path: str) -> None:
    """Part of one weather column is missing, as in tables that did not pass cleaning."""
    labelled = features.add_targets(features.build_features(t.merged), HOURLY, CI, list(TARGETS))
    ready = labelled.withColumn("weight", buckets.rarity_weight(F.col(CI)))
    holes = ready.withColumn("rain_mm", F.when(F.hour("datetime") != 7, F.col("rain_mm")))
    tables.write_table(features.one_hot(holes.withColumn("zone_name", F.col("zone")), "zone", ZONES).withColumnRenamed("zone_name", "zone"), path)


def matrix_columns(df: DataFrame) -> list[str]:
    chosen = features.FeatureColumns(categories={"zone": ZONES}).choose(df)
    return [c for c in chosen if c not in (*TARGETS.values(), "weight")]


def divided(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    first, second = (F.lit(d).cast("timestamp") for d in (FIRST, SECOND))
    ts = F.col("datetime")
    return df.filter(ts <= first), df.filter((ts > first) & (ts <= second)), df.filter(ts > second)


def some(df: DataFrame, label: str) -> DataFrame:
    """At most FIT_ROWS labelled rows to fit on; scores and predictions cover every row."""
    return df.dropna(subset=[label]).orderBy(F.xxhash64("zone", "datetime"), "zone", "datetime").limit(FIT_ROWS)


def fitted(t: Tables) -> tuple[dict, tuple[DataFrame, DataFrame, DataFrame]]:
    """One model per horizon, saved and loaded again, and the parts."""
    parts = divided(model_table(t))
    inputs = matrix_columns(parts[0])

    def fit(path: str) -> None:
        made = {h: model.fit_horizon(some(parts[0], c), some(parts[1], c), inputs, c, SMALL, "weight") for h, c in TARGETS.items()}
        model.save_models(made, path)

    path = written(t, "models", fit)
    return model.load_models(list(TARGETS), [f"{path}-newer", path]), parts


@query(
    "m5_fit_and_score",
    f"""{MODEL_SQL} SELECT horizon_hours, split, count(actual) AS n_samples, avg(actual) AS mean_actual, true AS in_range FROM long GROUP BY 1, 2""",
    floats="mean_actual",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Scores of every horizon and split: their rows, and that 0 <= mae <= rmse and r2 <= 1."""
    models, (train, val, test) = fitted(t)
    table: DataFrame | None = None
    for h, c in TARGETS.items():
        splits = {"train": train, "val": val, "test": test}
        scored = model.split_scores(models[h], splits, c)
        sizes = train.unionByName(val).unionByName(test).dropna(subset=[c])
        split = F.when(F.col("datetime") <= F.lit(FIRST).cast("timestamp"), "train").when(F.col("datetime") <= F.lit(SECOND).cast("timestamp"), "val").otherwise("test")
        counted = sizes.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n_samples"), F.avg(c).alias("mean_actual"))
        fine = (F.col("mae") >= 0) & (F.col("mae") <= F.col("rmse")) & (F.col("r2") <= 1)
        part = counted.join(scored, "split").select(F.lit(h).alias("horizon_hours"), "split", "n_samples", "mean_actual", fine.alias("in_range"))
        table = part if table is None else table.unionByName(part)
    return table


@query("m6_importances", f"""SELECT h AS horizon_hours, features, 1.0::DOUBLE AS total FROM (SELECT unnest([{', '.join(map(str, TARGETS))}]) AS h, 94 AS features, count(*) AS n FROM merged)""", ctes="merged")
def _(t: Tables) -> DataFrame:
    """Every feature of the matrix has an importance, and they add up to one."""
    models, _parts = fitted(t)
    table: DataFrame | None = None
    for h, fit in models.items():
        part = model.importances(fit).agg(F.lit(h).alias("horizon_hours"), F.count("feature").cast("int").alias("features"), F.sum("importance").alias("total"))
        table = part if table is None else table.unionByName(part)
    return table


SEARCHED = {"trees": (2, 5), "depth": (2, 4), "step": (0.05, 0.3), "subsample": (0.5, 1.0), "columns": (0.5, 1.0), "min_rows": (1, 20)}
TRIALS = 20


@query("m7_random_search", f"SELECT {TRIALS} AS trials, 1 AS best, true AS in_space, true AS best_is_smallest FROM (SELECT count(*) FROM merged)", ctes="merged")
def _(t: Tables) -> DataFrame:
    """All trials of the search over its six parameters."""
    train, val, _test = divided(model_table(t))
    label = TARGETS[12]
    best, history = model.random_search(kept(some(train, label), "fit-rows"), kept(val, "score-rows"), matrix_columns(train), label, TRIALS, SEARCHED, "weight")
    inside = all(a <= getattr(p, k) <= b for p, _mae in history for k, (a, b) in SEARCHED.items())
    smallest = min(mae for _p, mae in history) == next(mae for p, mae in history if p == best)
    rows = [(len(history), sum(p == best for p, _mae in history), inside, smallest)]
    return t.spark.createDataFrame(rows, "trials int, best int, in_space boolean, best_is_smallest boolean")


@query(
    "m7_tpe_search",
    f"""{MODEL_SQL}, val AS (SELECT count(actual) AS n, avg(actual) AS mean FROM long WHERE split = 'val' AND horizon_hours = 12)
SELECT CAST(trial AS INTEGER) AS trial, n AS rows_scored, mean AS mean_actual, true AS in_space, 1 AS best FROM val, range({TRIALS}) r(trial)""",
    floats="mean_actual",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Every trial of the Parzen search: the rows it was scored on, and that one trial is best."""
    train, val, _test = divided(model_table(t))
    label = TARGETS[12]
    trials = tuning.tpe_search(train, val, matrix_columns(train), label, SEARCHED, TRIALS, fit_on=kept(some(train, label), "fit-rows"), weight="weight")
    inside = reduce(lambda x, y: x & y, (F.col(k).between(a, b) for k, (a, b) in SEARCHED.items()))
    best = trials.agg(F.count_if(F.col("is_best") & (F.col("mae") >= 0)).cast("int").alias("best"))
    return trials.select("trial", "rows_scored", "mean_actual", inside.alias("in_space")).join(F.broadcast(best))


POINTS = {"trees": (1, 2, 3, 4, 5), "depth": (1, 2, 3, 4, 5), "step": (0.05, 0.1, 0.15, 0.2, 0.3)}


@query(
    "m8_sensitivity",
    "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {float(v)}::DOUBLE, true)" for p, vs in POINTS.items() for v in vs) + ") v(parameter, value, measured) WHERE (SELECT count(*) FROM merged) > 0",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Five points each for tree count, depth and step."""
    train, _val, _test = divided(model_table(t))
    found = model.sensitivity(some(train, TARGETS[12]).cache(), matrix_columns(train), TARGETS[12], SMALL, POINTS, parallelism=4)
    return found.select("parameter", "value", (F.col("mae") > 0).alias("measured"))


@query("m9_permutation_importance", f"""{MODEL_SQL} SELECT count(actual) AS rows_measured, 94 AS features, true AS finite FROM long WHERE split = 'val' AND horizon_hours = 12""", ctes="merged")
def _(t: Tables) -> DataFrame:
    """Every feature is permuted over all labelled rows, those with missing features too."""
    models, (_train, val, _test) = fitted(t)
    table = model.permutation_importance(models[12], val, matrix_columns(val), TARGETS[12], ["zone", "datetime"])
    summary = table.agg(F.count(F.lit(1)).cast("int").alias("features"), F.every(F.col("mae_increase").isNotNull() & ~F.isnan("mae_increase")).alias("finite"))
    rows = val.dropna(subset=[TARGETS[12]]).agg(F.count(F.lit(1)).alias("rows_measured"))
    return rows.withColumn("_one", F.lit(1)).join(summary.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query(
    "m9_attributions",
    f"""{MODEL_SQL} SELECT zone, datetime, 94 AS features, true AS adds_up FROM long WHERE split = 'val' AND horizon_hours = 12""",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Of every validation row: base and contributions of all features add up to the model's own prediction."""
    models, (_train, val, _test) = fitted(t)
    rows = attribution.attributions(models[12], val, ["zone", "datetime"])
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda s, x: s + x)
    fine = F.abs(total - F.col("raw")) <= 1e-9 * (1 + F.abs(F.col("raw")))
    return rows.select("zone", "datetime", F.size("contributions").alias("features"), fine.alias("adds_up"))


@query("m9_top_attributions")
def _(t: Tables) -> DataFrame:
    """The ten features with the largest mean absolute contribution over all validation rows."""
    models, (_train, val, _test) = fitted(t)
    names, _owner = attribution.feature_names(models[12])
    return attribution.top_attributions(attribution.attributions(models[12], val, ["zone"]), names)


PREDICTED_SQL = f"""{MODEL_SQL} SELECT zone, datetime, horizon_hours, 'gbt' AS model, actual, true AS at_floor FROM long WHERE split = 'test'"""


@query("m10_predict_horizons", PREDICTED_SQL, ctes="merged")
def _(t: Tables) -> DataFrame:
    """Every test row has a prediction per horizon, not below 0."""
    models, (_train, _val, test) = fitted(t)
    rows = model.predict_horizons(models, test, ["zone", "datetime"], TARGETS)
    return rows.select("zone", "datetime", "horizon_hours", "model", "actual", (F.col("predicted") >= 0).alias("at_floor"))


@query("m11_prediction_table", PREDICTED_SQL.replace("true AS at_floor", "actual IS NOT NULL AS has_error"), ctes="merged")
def _(t: Tables) -> DataFrame:
    models, (_train, _val, test) = fitted(t)
    table = model.prediction_table(models, test, TARGETS)
    right = F.abs(F.col("predicted") - F.col("actual")) - F.col("abs_error")
    return table.select("zone", "datetime", "horizon_hours", "model", "actual", F.coalesce(F.abs(right) < 0.011, F.lit(False)).alias("has_error"))


@query(
    "m16_zone_forecasts",
    f"""SELECT zone, datetime, h AS horizon_hours, true AS at_floor, true AS has_level FROM (SELECT zone, datetime, unnest([{', '.join(map(str, TARGETS))}]) AS h
FROM merged QUALIFY row_number() OVER (PARTITION BY zone ORDER BY datetime DESC) <= 24)""",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """The next day of every zone from its last 24 rows, with the level it is served under."""
    models, (_train, _val, test) = fitted(t)
    scored = model.predict_horizons(models, latest_rows(test, HOURLY, 24), ["zone", "datetime"])
    served = half_even(F.greatest(F.col("predicted"), F.lit(50.0)), 1)
    levels = F.lit(50.0) <= served
    return scored.select("zone", "datetime", "horizon_hours", levels.alias("at_floor"), buckets.service_level(served).isNotNull().alias("has_level"))


@query(
    "m18_rows_in_rows_out",
    """SELECT count(*) AS rows_in, count(*) AS rows_predicted, count(*) FILTER (hour(datetime) = 7) AS rows_with_missing FROM merged""",
    ctes="merged",
)
def _(t: Tables) -> DataFrame:
    """Rows with a missing feature are predicted like any other."""
    models, parts = fitted(t)
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = model.predict(models[12], every).agg(F.count("predicted").alias("rows_predicted"), F.count_if(F.col("rain_mm").isNull()).alias("rows_with_missing"))
    rows = every.agg(F.count(F.lit(1)).alias("rows_in")).withColumn("_one", F.lit(1))
    return rows.join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")


AUDIT_SQL = f"""{MODEL_SQL} SELECT horizon_hours, zone AS slice_value, count(*) AS n_samples FROM long WHERE split = 'test' AND actual IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10"""


@query("m19_model_slice_audit", AUDIT_SQL, ctes="merged")
def _(t: Tables) -> DataFrame:
    """Fit, predict, score per slice, compare the slices with the whole."""
    models, (_train, _val, test) = fitted(t)
    path = scratch_path(t.spark, "predictions")
    keep = ["zone", "datetime", "temperature_2m_c", "wind_speed_100m_ms", "cloud_cover_pct"]
    tables.write_table(model.predict_horizons(models, test, keep, TARGETS).filter(F.col("actual").isNotNull()), path)
    found = metrics.disparities(metrics.slice_scores(t.spark.read.parquet(path)))
    return found.filter(F.col("slice_type") == "zone").select("horizon_hours", "slice_value", "n_samples")
