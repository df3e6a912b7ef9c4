"""Correcting deliveries: the latest version of every row wins, and only touched partitions are rewritten.

The table is partitioned by the key's first column and by day. A delivery is reduced to one row per key and compared with
the stored partitions it falls into. Rows that beat what is stored name the partitions to write anew; Spark's
dynamic partition overwrite replaces exactly those. A delivery that comes again beats nothing, so it
changes no file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import path_exists, written

DAY = "delivery_day"


def _order(columns: Sequence[str], keys: Sequence[str], version: str) -> Column:
    """What the winner of a key has most of: the version, then its values, so that equal versions have one winner."""
    return F.struct(F.col(version), *[F.col(c) for c in columns if c not in (*keys, version, DAY)])


def latest_per_key(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key, of the highest version; a key's rows are reduced before the shuffle."""
    others = [c for c in rows.columns if c not in (*keys, version)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(version), *others)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rows.columns if c not in keys])


def read_deliveries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table without its day column; no rows before the first delivery."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop(DAY).select(*spark.createDataFrame([], schema).columns)


def merge_delivery(delivery: DataFrame, path: str, keys: Sequence[str], time: str, version: str) -> int:
    """Merge a delivery into the table at ``path``; the number of partitions written.

    ``keys`` begin with the partition column and contain ``time``. Rows without a key, time or version are not taken. A row
    wins if its key is new or its version is higher than the stored one, or equal with larger values; so the result
    does not depend on the order of deliveries. Partitions are read and written as wholes: their size
    is a key's day.
    """
    spark, columns, parts = delivery.sparkSession, delivery.columns, [keys[0], DAY]
    sound = delivery.dropna(subset=[*keys, version])
    fresh = written(latest_per_key(sound, keys, version).withColumn(DAY, F.to_date(time)), "delivery")
    if path_exists(spark, path):
        stored = spark.read.parquet(path).select(*columns, DAY)
        touched = fresh.select(*parts).distinct()
        held = written(stored.join(touched, parts, "left_semi"), "held")
        known = held.select(*keys, _order(columns, keys, version).alias("_held"))
        beaten = F.col("_held").isNull() | (_order(columns, keys, version) > F.col("_held"))
        winners = written(fresh.join(known, list(keys), "left").where(beaten).drop("_held"), "winners")
        kept = held.join(winners.select(*parts).distinct(), parts, "left_semi")
        table = latest_per_key(kept.unionByName(winners), keys, version)
    else:
        winners = table = fresh
    changed = winners.select(*parts).distinct().count()
    if changed:
        rows = table.repartition(*parts).sortWithinPartitions(*parts, time)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    return changed


def merge_available(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time: str, version: str) -> StreamingQuery:
    """Merge everything that has landed; a micro-batch that runs again after a failure changes nothing."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_delivery(batch, path, keys, time, version)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
