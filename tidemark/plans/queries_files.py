"""Queries over files: landing folders, chunk plans, stage tables, reports and logs.

Each writes what it reads back below the shared scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.operators import clean, features, profile, quality, split
from tidemark.operators.series import regularise_and_fill
from tidemark.plans.canonical import GRID_VALUES, HOURLY, TRAIN_END, VAL_END, WEATHER_VALUES, Tables, axis_sql, filled_sql
from tidemark.plans.queries_reports import DISTRIBUTION_FLOATS, DISTRIBUTION_SQL, SLICED_SQL, audit, sliced
from tidemark.plans.queries_series import SIGNAL_SQL, SIGNALS, signal_readings
from tidemark.plans.queries_tables import RAW_SQL, SPLIT_CASE, raw_signal
from tidemark.plans.registry import query
from tidemark.session import scratch_path
from tidemark.sources import chunks, landing, tables

CI, LOAD = GRID_VALUES[0], GRID_VALUES[4]
SIGNAL_SCHEMA = "event_id long, datetime string, carbonIntensity string"


def landed_lines(t: Tables) -> str:
    """Signal lines per zone; some lines are cut off and unreadable."""
    path = scratch_path(t.spark, "landing")
    whole = F.to_json(F.struct("event_id", "datetime", "carbonIntensity"))
    line = F.when(F.col("carbonIntensity") == "n/a", F.substring(whole, 1, 20)).otherwise(whole)
    raw_signal(t).select("zone", line.alias("value")).write.partitionBy("zone").text(path)
    return path


@query("s1_read_jsonl", f"""SELECT event_id, datetime, "carbonIntensity", zone FROM ({RAW_SQL}) WHERE "carbonIntensity" <> 'n/a'""")
def _(t: Tables) -> DataFrame:
    rows = landing.read_jsonl(t.spark, landed_lines(t), SIGNAL_SCHEMA, pattern="*.txt")
    return rows.withColumn("zone", F.regexp_extract("file", "zone=([^/]+)/", 1)).drop("file")


@query("s1_quarantined_lines", f"""SELECT zone, count(*) AS lines FROM ({RAW_SQL}) WHERE "carbonIntensity" = 'n/a' GROUP BY zone""")
def _(t: Tables) -> DataFrame:
    bad = landing.quarantine(t.spark, landed_lines(t), SIGNAL_SCHEMA, pattern="*.txt")
    return bad.groupBy(F.regexp_extract("file", "zone=([^/]+)/", 1).alias("zone")).agg(F.count(F.lit(1)).alias("lines"))


def landed_csv(t: Tables) -> str:
    """Weather CSV folders per location, in three header forms, and a file per location that has no times."""
    path = scratch_path(t.spark, "weather")
    text = t.weather.select(
        F.col("zone").alias("location"), F.date_format("datetime", "yyyy-MM-dd'T'HH:mm").alias("time"), *WEATHER_VALUES
    )
    by_location = lambda rows, form, **options: rows.write.options(header="true", **options).partitionBy("location").csv(f"{path}/{form}")
    by_location(text.filter(F.col("location") < "p"), "wide")
    by_location(text.filter(F.col("location") == "purchase").select("location", *reversed(WEATHER_VALUES), "time"), "turned")
    narrow = text.filter(F.col("location") > "purchase").select("location", WEATHER_VALUES[2], "time", WEATHER_VALUES[0])
    by_location(narrow, "quoted", quoteAll="true")
    text.select("location").distinct().withColumn("remark", F.lit("no times")).write.option("header", "true").partitionBy("location").csv(f"{path}/broken")
    return path


CSV_SQL = (
    "SELECT {zone} strftime(datetime, '%Y-%m-%dT%H:%M') AS time, "
    + ", ".join(c if c in (WEATHER_VALUES[0], WEATHER_VALUES[2]) else f"CASE WHEN zone <= 'purchase' THEN {c} END AS {c}" for c in WEATHER_VALUES)
    + " FROM weather"
)


@query("s2_read_csv", CSV_SQL.format(zone=""), ctes="weather")
def _(t: Tables) -> DataFrame:
    rows = landing.read_csv_folder(t.spark, landed_csv(t))
    return rows.select("time", *[parsing.to_number(F.col(c)).alias(c) for c in WEATHER_VALUES])


@query("s2_quarantined_csv", "SELECT 'remark' AS header, count(DISTINCT zone) AS files FROM weather", ctes="weather")
def _(t: Tables) -> DataFrame:
    bad = landing.csv_quarantine(t.spark, landed_csv(t))
    return bad.groupBy("header").agg(F.count_distinct("file").alias("files"))


@query("s3_tag_zones", CSV_SQL.format(zone="zone,"), ctes="weather")
def _(t: Tables) -> DataFrame:
    folders = t.readings.select("zone", F.concat(F.lit("location="), "zone").alias("folder")).distinct()
    rows = landing.tag_zone(landing.read_csv_folder(t.spark, landed_csv(t)), folders)
    return rows.select("zone", "time", *[parsing.to_number(F.col(c)).alias(c) for c in WEATHER_VALUES])


RANGES = {CI: (5.0, 30.0), LOAD: (10.0, 80.0)}
CLEAN_WINDOW = ("2024-01-03", "2024-01-27")


def _clipped(c: str) -> str:
    low, high = RANGES[c]
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({low}, least({high}, {c})) END AS {c}"


E2E_SQL = f"""WITH {SIGNAL_SQL},
joined AS (SELECT * FROM a FULL JOIN b USING (zone, datetime) FULL JOIN c USING (zone, datetime) FULL JOIN d USING (zone, datetime) FULL JOIN e USING (zone, datetime) FULL JOIN f USING (zone, datetime)),
steps AS ({axis_sql('joined')}), whole AS ({filled_sql(GRID_VALUES, 'steps')}),
cleaned AS (SELECT * REPLACE ({_clipped(CI)}, {_clipped(LOAD)}) FROM whole WHERE datetime >= TIMESTAMP '{CLEAN_WINDOW[0]}' AND datetime < TIMESTAMP '{CLEAN_WINDOW[1]}' + INTERVAL 1 DAY),
both_sides AS (SELECT c.*, v.temperature_2m_c, v.cloud_cover_pct FROM cleaned c JOIN weather_filled v USING (zone, datetime)),
made AS (SELECT zone, datetime, {CI}, {LOAD}, temperature_2m_c, lag({CI}, 24) OVER w AS l24, avg({CI}) OVER (w ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS m24, lead({CI}, 12) OVER w AS carbon_intensity_target_12h
  FROM both_sides WINDOW w AS (PARTITION BY zone ORDER BY datetime))
SELECT zone, datetime, CASE WHEN zone < 'p' THEN upper(zone) ELSE 'unknown' END AS cloud_region, {CI}, coalesce({LOAD}, 0) AS {LOAD}, temperature_2m_c,
  coalesce(l24, first_value(l24 IGNORE NULLS) OVER (PARTITION BY zone ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {CI}_lag_24h,
  m24 AS {CI}_mean_24h, carbon_intensity_target_12h,
  CASE WHEN datetime <= TIMESTAMP '2024-01-18' THEN 'train' WHEN datetime <= TIMESTAMP '2024-01-23' THEN 'val' ELSE 'test' END AS split
FROM made WHERE carbon_intensity_target_12h IS NOT NULL"""


@query("e1_files_to_splits", E2E_SQL, floats=f"{CI}_mean_24h", digits=5, ctes="readings weather_filled")
def _(t: Tables) -> DataFrame:
    """Landed signal lines and weather files to clean, merged, featured, labelled and split rows."""
    path = scratch_path(t.spark, "e2e")
    line = F.to_json(F.struct("event_id", parsing.format_iso_z(F.col("datetime")).alias("datetime"), F.col("value").cast("string").alias("value")))
    signal_readings(t).select("zone", "signal", line.alias("line")).write.partitionBy("zone", "signal").text(f"{path}/signals")
    lines = landing.read_jsonl(t.spark, f"{path}/signals", "event_id long, datetime string, value string", pattern="*.txt")
    long = lines.select(
        F.regexp_extract("file", "zone=([^/]+)/", 1).alias("zone"),
        F.regexp_extract("file", "signal=([^/]+)/", 1).alias("signal"),
        parsing.parse_utc(F.col("datetime")).alias("datetime"),
        parsing.to_number(F.col("value")).alias("value"),
        "event_id",
    )
    zones = t.readings.filter(F.col("zone") < "p").select("zone", F.upper("zone").alias("cloud_region")).distinct()
    grid = clean.clean_signals(long, SIGNALS, ["event_id"], HOURLY, RANGES, zones, ["cloud_region"], CLEAN_WINDOW)
    folders = t.readings.select("zone", F.concat(F.lit("location="), "zone").alias("folder")).distinct()
    rows = landing.tag_zone(landing.read_csv_folder(t.spark, landed_csv(t)), folders)
    hours = rows.select("zone", F.to_timestamp("time").alias("datetime"), *[parsing.to_number(F.col(c)).alias(c) for c in WEATHER_VALUES])
    weather = regularise_and_fill(clean.keep_first(hours, ["zone", "datetime"], list(WEATHER_VALUES)), HOURLY, WEATHER_VALUES)
    stage = f"{path}/merged"
    tables.write_table(clean.merge_on_key(grid, weather), stage)
    ready = features.add_targets(features.build_features(t.spark.read.parquet(stage)), HOURLY, CI, [12])
    done = split.assign_split(split.drop_unlabelled(ready), "2024-01-18", "2024-01-23")
    return done.select(
        "zone", "datetime", "cloud_region", CI, LOAD, "temperature_2m_c", f"{CI}_lag_24h", f"{CI}_mean_24h", "carbon_intensity_target_12h", "split"
    )


def file_names(t: Tables) -> DataFrame:
    """The landing file each event would arrive in: one per zone, signal and day."""
    day = F.date_trunc("day", "datetime")
    signal = F.when(F.col("k") < 50, "carbon-intensity").otherwise("total-load")
    name = chunks.chunk_file_name(day, day + F.expr("interval '1' day"))
    return t.readings.select(
        "event_id", F.concat(F.lit("raw/hourly/zone="), "zone", F.lit("/"), signal, F.lit("/"), name).alias("file")
    )


@query(
    "s4_path_fields",
    """SELECT event_id, 'hourly' AS mode, zone, CASE WHEN k < 50 THEN 'carbon-intensity' ELSE 'total-load' END AS signal,
  date_trunc('day', datetime)::TIMESTAMP AS chunk_start, date_trunc('day', datetime)::TIMESTAMP + INTERVAL 1 DAY AS chunk_end FROM readings""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return file_names(t).select("event_id", *[c.alias(n) for n, c in landing.path_columns(F.col("file")).items()])


@query(
    "s5_newest_files",
    """SELECT event_id, zone, CASE WHEN k < 50 THEN 'carbon-intensity' ELSE 'total-load' END AS signal FROM readings
QUALIFY date_trunc('day', datetime) = max(date_trunc('day', datetime)) OVER (PARTITION BY zone, k < 50)""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    fields = landing.path_columns(F.col("file"))
    named = file_names(t).select("*", fields["zone"].alias("zone"), fields["signal"].alias("signal"))
    return landing.newest_files(named, ["zone", "signal"]).drop("file")


@query("s6_parquet_table", "SELECT * FROM observed", ctes="observed")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "grid")
    tables.write_table(t.grid_observed, path, ["zone"], ["datetime"])
    return tables.read_table(t.spark, path).select(*t.grid_observed.columns)


@query(
    "s7_jsonl_lines",
    """SELECT '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value FROM events""",
)
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "jsonl")
    tables.write_jsonl(t["events"].select("event_id", "user_id", "event_type"), path)
    return t.spark.read.text(path)


@query("s8_csv_table", f"SELECT zone, strftime(datetime, '%Y-%m-%d %H') AS hour, {CI} FROM observed", ctes="observed")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    tables.write_csv(t.grid_observed.select("zone", F.date_format("datetime", "yyyy-MM-dd HH").alias("hour"), CI), path)
    return t.spark.read.option("header", "true").schema(f"zone string, hour string, {CI} double").csv(path)


@query(
    "s9_weather_payload",
    "SELECT zone, datetime + INTERVAL 5 HOUR AS time, temperature_2m_c, rain_mm FROM weather",
    ctes="weather",
)
def _(t: Tables) -> DataFrame:
    """A day's payload per zone in New York wall-clock time, read back as UTC rows."""
    day = F.date_trunc("day", "datetime")
    hours = F.sort_array(F.collect_list(F.struct("datetime", "temperature_2m_c", "rain_mm")))
    days = t.weather.groupBy("zone", day.alias("day")).agg(hours.alias("h"))
    hourly = F.struct(
        F.transform("h", lambda x: F.date_format(x["datetime"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.transform("h", lambda x: x["temperature_2m_c"]).alias("temperature_2m_c"),
        F.transform("h", lambda x: x["rain_mm"]).alias("rain_mm"),
    )
    payloads = days.select("zone", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))
    return landing.weather_payload_rows(
        payloads, "payload", {"temperature_2m_c": "double", "rain_mm": "double"}, "America/New_York"
    )


@query(
    "s10_envelope",
    """SELECT event_id, whole AS value FROM readings WHERE zone <> 'view' UNION ALL SELECT event_id, k FROM readings WHERE zone <> 'view'
UNION ALL SELECT event_id, whole FROM readings WHERE zone = 'view'""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    record = F.struct(F.col("whole").alias("value"))
    pair = F.struct(F.array(record, F.struct(F.col("k").cast("long").alias("value"))).alias("data"))
    payload = F.when(F.col("zone") == "view", F.to_json(record)).otherwise(F.to_json(pair))
    return landing.envelope_rows(t.readings.select("event_id", payload.alias("payload")), "payload", "value: bigint")


def spans(t: Tables) -> DataFrame:
    return t.readings.groupBy("zone").agg(F.min("datetime").alias("start"), F.max("datetime").alias("end"))


SPAN_SQL = "spans AS (SELECT zone, min(datetime) AS s, max(datetime) AS e FROM readings GROUP BY zone)"


@query(
    "s11_backfill_chunks",
    f"""WITH {SPAN_SQL} SELECT zone, c AS chunk_start, least(c + INTERVAL 4 DAY, e) AS chunk_end
FROM (SELECT zone, e, unnest(generate_series(s, e, INTERVAL 4 DAY)) AS c FROM spans) WHERE c < e""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return chunks.backfill_chunks(spans(t), 4).drop("start", "end")


@query(
    "s12_hourly_chunks",
    """WITH n AS (SELECT zone, max(ts) AS now FROM readings GROUP BY zone)
SELECT zone, date_trunc('hour', now) - to_hours(h) AS chunk_start, date_trunc('hour', now) - to_hours(h) + INTERVAL 1 HOUR AS chunk_end FROM n, (VALUES (1), (2)) v(h)""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return chunks.hourly_chunks(t.readings.groupBy("zone").agg(F.max("ts").alias("now"))).drop("now")


@query(
    "s13_inclusive_chunks",
    f"""WITH {SPAN_SQL} SELECT zone, c AS chunk_start, least(c + INTERVAL 6 DAY, e) AS chunk_end
FROM (SELECT zone, e, unnest(generate_series(s, e, INTERVAL 7 DAY)) AS c FROM spans) WHERE c < e""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return chunks.inclusive_chunks(spans(t), 6).drop("start", "end")


STORES_SQL = """a AS (SELECT zone, date_trunc('day', datetime)::TIMESTAMP AS chunk, count(*) AS bytes FROM readings WHERE k < 80 GROUP BY 1, 2),
b AS (SELECT zone, date_trunc('day', datetime)::TIMESTAMP AS chunk, count(*) AS bytes FROM readings WHERE zone <> 'view' GROUP BY 1, 2),
done AS (SELECT a.zone, a.chunk FROM a JOIN b USING (zone, chunk) WHERE a.bytes >= 10 AND b.bytes >= 10)"""


def stores(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All day chunks, and two stores whose file sizes are event counts."""
    day = F.date_trunc("day", "datetime").alias("chunk")
    size = F.count(F.lit(1)).alias("bytes")
    primary = t.readings.filter(F.col("k") < 80).groupBy("zone", day).agg(size)
    mirror = t.readings.filter(F.col("zone") != "view").groupBy("zone", day).agg(size)
    return t.readings.select("zone", day).distinct(), primary, mirror


@query("s14_landed_chunks", f"WITH {STORES_SQL} SELECT * FROM done", ctes="readings")
def _(t: Tables) -> DataFrame:
    _, primary, mirror = stores(t)
    return chunks.landed(primary, mirror, ["zone", "chunk"])


@query(
    "j9_pending_chunks",
    f"WITH {STORES_SQL} SELECT DISTINCT zone, date_trunc('day', datetime)::TIMESTAMP AS chunk FROM readings EXCEPT SELECT * FROM done",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    plan, primary, mirror = stores(t)
    return chunks.pending_chunks(plan, chunks.landed(primary, mirror, ["zone", "chunk"]), ["zone", "chunk"])


@query("s15_csv_report", f"WITH {SLICED_SQL} {DISTRIBUTION_SQL}", floats=DISTRIBUTION_FLOATS, ctes="daily")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "report")
    report = profile.slice_distribution(sliced(t), profile.SLICES)
    tables.write_report_csv(report, path)
    return t.spark.read.option("header", "true").schema(report.schema).csv(path)


@query(
    "s16_json_report",
    """SELECT '{"strategy":"random_oversampling","zone":"' || zone || '","rows":' || count(*) || '}' AS report FROM readings GROUP BY zone""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    counts = t.readings.groupBy("zone").agg(F.count(F.lit(1)).alias("rows"))
    return tables.json_report(counts, strategy=F.lit("random_oversampling"))


@query(
    "s17_audit_log",
    """SELECT o_orderkey AS entry, o_orderpriority AS model_type, CAST(o_custkey AS VARCHAR) AS version FROM orders WHERE o_orderpriority = '2-HIGH'""",
)
def _(t: Tables) -> DataFrame:
    """Two appends and a line that is no JSON."""
    path = scratch_path(t.spark, "audit")
    entries = audit(t).select("entry", "model_type", "version")
    early = F.col("entry") % 2 == 0
    tables.append_log(entries.filter(early), path)
    tables.append_log(entries.filter(~early), path)
    entries.select(F.lit("{broken").alias("value")).limit(3).write.mode("append").text(path)
    return tables.read_log(t.spark, path, "entry long, model_type string, version string", "2-HIGH")


@query("s18_load_split", f"SELECT zone, datetime, {CI}, 'val' AS split FROM (SELECT *, {SPLIT_CASE} AS s FROM daily) WHERE s = 'val'", ctes="daily")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "splits")
    split.write_splits(split.assign_split(t.daily_observed.select("zone", "datetime", CI), TRAIN_END, VAL_END), path)
    return tables.load_split(t.spark, path, "val")


def written_reports(t: Tables) -> DataFrame:
    """Two runs of a report at two horizons; the second run has other rows."""
    path = scratch_path(t.spark, "reports")
    for run, late in (("20240101", False), ("20240102", True)):
        for horizon in ("1h", "12h"):
            table = t.readings.groupBy("zone").agg(F.count(F.lit(1)).alias("rows"))
            table = table.withColumn("rows", F.col("rows") + (1000 if late else 0)).withColumn("horizon", F.lit(horizon))
            tables.write_report_csv(table, f"{path}/disparity_report_gbt_{horizon}_{run}")
    return tables.read_reports(t.spark, path, "zone string, rows long, horizon string")


@query(
    "s19_all_reports",
    """SELECT zone, rows + x AS rows, horizon FROM (SELECT zone, count(*) AS rows FROM readings GROUP BY zone), (VALUES ('1h'), ('12h')) h(horizon), (VALUES (0), (1000)) v(x)""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    return written_reports(t).select("zone", "rows", "horizon")


@query(
    "s20_newest_reports",
    """SELECT zone, rows + 1000 AS rows, horizon FROM (SELECT zone, count(*) AS rows FROM readings GROUP BY zone), (VALUES ('1h'), ('12h')) h(horizon)""",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    reports = written_reports(t).withColumn("label", tables.horizon_from_name(F.col("_path")))
    return tables.newest_reports(reports, ["label"]).select("zone", "rows", F.col("label").alias("horizon"))


# --- hourly checks -------------------------------------------------------------------------

ISSUE_SQL = """f AS (SELECT zone, signal, max(day) AS day FROM l GROUP BY zone, signal),
n AS (SELECT l.* FROM l JOIN f USING (zone, signal, day)),
s AS (SELECT zone, signal, day, count(*) FILTER (dt IS NULL) AS bad, avg(CAST(v IS NULL AS INTEGER)) AS rate, bool_or(unreadable) AS unreadable FROM n GROUP BY ALL),
r AS (SELECT zone, signal, day, sum(c - 1) AS dup FROM (SELECT zone, signal, day, dt, count(*) AS c FROM n GROUP BY ALL) GROUP BY ALL)"""


@query(
    "q3_grid_file_issues",
    f"""WITH l AS (SELECT zone, CASE WHEN k < 50 THEN 'carbon-intensity' ELSE 'total-load' END AS signal, date_trunc('day', datetime) AS day,
  CASE WHEN k <> 13 THEN datetime END AS dt, CASE WHEN k >= 30 THEN whole END AS v, zone = 'error' AND k = 7 AS unreadable FROM readings), {ISSUE_SQL},
x AS (SELECT * FROM s JOIN r USING (zone, signal, day))
SELECT zone, signal, 'missing file' AS issue, NULL::DOUBLE AS size FROM (SELECT DISTINCT zone, 'net-load' AS signal FROM readings)
UNION ALL SELECT zone, signal, 'unreadable file', NULL FROM x WHERE unreadable
UNION ALL SELECT zone, signal, 'bad datetimes', bad FROM x WHERE bad > 0 AND NOT unreadable
UNION ALL SELECT zone, signal, 'duplicate datetimes', dup FROM x WHERE dup > 0 AND NOT unreadable
UNION ALL SELECT zone, signal, 'high null rate', rate FROM x WHERE rate > 0.5 AND NOT unreadable""",
    floats="size",
    ctes="readings",
)
def _(t: Tables) -> DataFrame:
    fields = landing.path_columns(F.col("file"))
    record = F.struct(
        F.when(F.col("k") == 13, "yesterday").otherwise(parsing.format_iso_z(F.col("datetime"))).alias("datetime"),
        F.when(F.col("k") < 30, "n/a").otherwise(F.col("whole").cast("string")).alias("value"),
    )
    line = F.when((F.col("zone") == "error") & (F.col("k") == 7), "{cut").otherwise(F.to_json(record))
    lines = t.readings.join(file_names(t), "event_id").select("file", line.alias("value"))
    records = quality.file_records(lines).select("file", "record", fields["zone"].alias("zone"), fields["signal"].alias("signal"))
    expected = t.readings.select("zone").distinct().withColumn(
        "signal", F.explode(F.array(F.lit("carbon-intensity"), F.lit("total-load"), F.lit("net-load")))
    )
    return quality.grid_file_issues(records, expected).drop("file")


@query(
    "q4_weather_file_issues",
    """WITH l AS (SELECT zone AS location, date_trunc('day', datetime) AS day, CASE WHEN rain_mm <> 0 THEN datetime END AS dt, CASE WHEN temperature_2m_c >= 20 THEN temperature_2m_c END AS v FROM weather),
f AS (SELECT location, max(day) AS day FROM l GROUP BY 1), n AS (SELECT * FROM l JOIN f USING (location, day)),
s AS (SELECT location, count(*) FILTER (dt IS NULL) AS bad, avg(CAST(v IS NULL AS INTEGER)) AS rate FROM n GROUP BY 1),
r AS (SELECT location, sum(c - 1) AS dup FROM (SELECT location, dt, count(*) AS c FROM n GROUP BY ALL) GROUP BY 1)
SELECT location, 'bad datetimes' AS issue, bad::DOUBLE AS size FROM s WHERE bad > 0
UNION ALL SELECT location, 'duplicate datetimes', dup FROM r WHERE dup > 0
UNION ALL SELECT location, 'high null rate', rate FROM s WHERE rate > 0.5""",
    floats="size",
    ctes="weather",
)
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("rain_mm") == 0, "soon").otherwise(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm"))
    rows = t.weather.select(
        F.col("zone").alias("location"),
        F.date_format("datetime", "yyyyMMdd").alias("file"),
        text.alias("time"),
        F.when(F.col("temperature_2m_c") < 20, "").otherwise(F.col("temperature_2m_c").cast("string")).alias("temperature_2m"),
        F.array(F.lit("time"), F.lit("temperature_2m")).alias("_columns"),
    )
    expected = t.weather.select(F.col("zone").alias("location")).distinct()
    return quality.weather_file_issues(rows, expected, ["temperature_2m"]).drop("file")
