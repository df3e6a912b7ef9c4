"""Stage tables, reports and the audit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.landing import file_name, read_jsonl


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Snappy Parquet. Partitioned output is spread by partition and sort columns, so a
    large partition is written by many tasks.
    """
    if partition_by and sort_by:
        df = df.repartitionByRange(*partition_by, *sort_by).sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, sort_by: Sequence[str] = ()) -> DataFrame:
    """A stored table cut into ``buckets`` files by a hash of ``keys``, each sorted by the keys and ``sort_by``; returned as read.

    Tables of equal keys and bucket counts are joined, and grouped by their keys, without an exchange. One shuffle here replaces one
    per later use. Keys should have many values, such as (zone, datetime), as a key's rows lie in one bucket; a bucket
    is one task's work, so its count grows with the table. Null keys are rows like others and join nothing.
    ``name`` is replaced in the session's catalog, the files in ``path``.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").option("compression", "snappy")
    writer.bucketBy(buckets, *keys).sortBy(*keys, *sort_by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def jsonl_lines(df: DataFrame) -> DataFrame:
    """Each row as one line of JSON; null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """One CSV part. Meant for reports, whose rows are slices and not data."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def json_report(df: DataFrame, **labels: Column) -> DataFrame:
    """One JSON text per row, with extra labelled fields."""
    named = [c.alias(n) for n, c in labels.items()]
    return df.select(F.to_json(F.struct(*named, *df.columns)).alias("report"))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, model_type: str | None = None) -> DataFrame:
    """Log entries; malformed lines are skipped."""
    entries = read_jsonl(spark, path, schema, pattern="*").drop("file")
    return entries.filter(F.col("model_type") == model_type) if model_type else entries


def first_readable(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first of several Parquet paths that exists."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {list(paths)} is readable")


def load_split(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One split of a table written by ``split``; only its folder is read."""
    if name not in ("train", "val", "test"):
        raise ValueError(f"unknown split {name!r}")
    return spark.read.parquet(base).filter(F.col("split") == name)


def read_reports(spark: SparkSession, path: str, schema: str, glob: str = "*.csv") -> DataFrame:
    """All report files of a folder tree, with their name and modification time."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .csv(path)
        .select(
            "*",
            F.col("_metadata.file_path").alias("_path"),
            file_name(F.col("_metadata.file_path")).alias("_source_file"),
            F.col("_metadata.file_modification_time").alias("_modified"),
        )
    )


def newest_reports(reports: DataFrame, by: Sequence[str], order: Sequence[str] = ("_modified", "_path")) -> DataFrame:
    """Rows of the newest report file per group."""
    newest = reports.groupBy(*by).agg(F.max_by("_path", F.struct(*order)).alias("_path"))
    return reports.join(newest, [*by, "_path"], "left_semi")


def horizon_from_name(name: Column) -> Column:
    """Horizon label such as ``12h`` between underscores of a report name."""
    return F.nullif(F.regexp_extract(name, r"_(\d+h)_", 1), F.lit(""))
