"""What the training-text operators share: reading tables, written intermediate tables, row keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import apply_runtime_conf, scratch_path

# Texts vary from empty to megabytes: small Arrow batches keep a Python worker's memory low.
ROWS_PER_BATCH = 400

# Words are runs of anything but the six ASCII white-space characters (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """The session settings that the operators expect."""
    apply_runtime_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, under the settings that the operators expect."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows from a table written to the shared folder.

    This cuts the lineage and computes costly input once: a lost executor costs a reread.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def buckets_for(rows: int, per_bucket: int) -> int:
    """Number of buckets that keeps each near ``per_bucket`` rows."""
    return max(1, -(-rows // per_bucket))


def texts(batch: Iterable[str | None]) -> list[str]:
    """Texts of a batch, null as the empty text."""
    return [t if isinstance(t, str) else "" for t in batch]
