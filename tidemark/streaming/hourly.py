"""The hourly flow as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.functions.parsing import to_number, try_parse_utc


def read_landing_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """JSON-lines files as they land. The checkpoint of the query remembers what was read."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def parse_readings(raw: DataFrame) -> DataFrame:
    return raw.select(
        "zone", "signal", try_parse_utc(F.col("datetime")).alias("datetime"), to_number(F.col("value")).alias("value")
    )


def first_delivery(readings: DataFrame, delay: str = "2 hours") -> DataFrame:
    """One reading per (zone, signal, time); later deliveries within the delay are dropped."""
    return readings.withWatermark("datetime", delay).dropDuplicatesWithinWatermark(["zone", "signal", "datetime"])


def hourly_values(readings: DataFrame, delay: str = "2 hours", time: str = "datetime") -> DataFrame:
    """Tumbling hours per zone, complete hours only."""
    return (
        readings.withWatermark(time, delay)
        .groupBy("zone", F.window(time, "1 hour"))
        .agg(F.count("value").alias("readings"), F.sum("value").alias("total"))
        .select("zone", F.col("window.start").alias("datetime"), "readings", "total")
    )


def rolling_values(readings: DataFrame, hours: int, delay: str = "2 hours", time: str = "datetime") -> DataFrame:
    """Statistics over the last ``hours``, advancing hourly."""
    return (
        readings.withWatermark(time, delay)
        .groupBy("zone", F.window(time, f"{hours} hours", "1 hour"))
        .agg(
            F.count("value").alias("readings"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
        .select("zone", F.col("window.end").alias("window_end"), "readings", "mean", "std", "min", "max")
    )


def join_weather(grid: DataFrame, weather: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Inner join of two hourly streams on zone and hour."""
    left = grid.withWatermark("datetime", delay)
    right = weather.withWatermark("datetime", delay)
    return left.join(right, ["zone", "datetime"], "inner")


def gate_batches(
    stream: DataFrame,
    valid: Column,
    good_path: str,
    quarantine_path: str,
    checkpoint: str,
    on_issues: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Write each micro-batch's valid rows and quarantine the rest.

    Both outputs live in a folder named by the batch, so a batch that is replayed after a
    failure replaces its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        # Both writes read the batch; keep it for the length of this call.
        batch = batch.persist()
        batch.filter(ok).write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad = batch.filter(~ok)
        bad.write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        if on_issues:
            on_issues(bad)
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def gate_files(
    stream: DataFrame,
    check: Callable[[DataFrame], DataFrame],
    keys: list[str],
    good_path: str,
    quarantine_path: str,
    issues_path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Run the landing checks on each micro-batch and part its files by the outcome.

    ``check`` gives the issues of a batch, with the ``keys`` of a file. All rows of a file with an
    issue are quarantined; the issues become a table. Every output has a folder per batch, so
    a replayed batch replaces its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Three writes read the batch; keep it for the length of this call.
        batch = batch.persist()
        issues = check(batch)
        issues.write.mode("overwrite").parquet(f"{issues_path}/batch={batch_id}")
        found = batch.sparkSession.read.schema(issues.schema).parquet(f"{issues_path}/batch={batch_id}").select(*keys).distinct()
        batch.join(found, keys, "left_anti").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        batch.join(found, keys, "left_semi").write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has landed into Parquet, then stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


class LateRowCounter(StreamingQueryListener):
    """Adds up the rows stateful operators dropped for being behind the watermark."""

    def __init__(self) -> None:
        self.dropped = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.dropped += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
