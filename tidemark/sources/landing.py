"""Reading landing folders of JSON-lines and CSV files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.parsing import local_to_utc

CORRUPT = "_corrupt_record"
FILE_TIME = "yyyyMMdd'T'HHmmss'Z'"


def path_columns(path: Column) -> dict[str, Column]:
    """Fields written into the path ``…/<mode>/zone=<Z>/<signal>/start=<t>_end=<t>.jsonl``."""
    layout = r"/([^/]+)/zone=([^/]+)/([^/]+)/start=([0-9TZ]+)_end=([0-9TZ]+)\.jsonl"

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, layout, i), F.lit(""))

    return {
        "mode": part(1),
        "zone": F.url_decode(part(2)),
        "signal": part(3),
        "chunk_start": F.try_to_timestamp(part(4), F.lit(FILE_TIME)),
        "chunk_end": F.try_to_timestamp(part(5), F.lit(FILE_TIME)),
    }


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_jsonl(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str,
    file_level: bool = False,
    pattern: str = "*.json*",
) -> DataFrame:
    """Rows of all JSON-lines files below ``path``, with their ``file``.

    Unreadable lines are left out; with ``file_level`` the whole file holding one is.
    """
    rows = read_jsonl_with_corrupt(spark, path, schema, pattern)
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if not file_level:
        return good
    # A file list; a bad file is named once per task before the shuffle.
    bad_files = rows.filter(F.col(CORRUPT).isNotNull()).select("file").distinct()
    return good.join(bad_files, "file", "left_anti").select(*good.columns)


def read_jsonl_with_corrupt(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, pattern: str = "*.json*"
) -> DataFrame:
    """Parsed fields of every line, with the line itself where it could not be parsed.

    Lines are read as text and parsed by an expression: the JSON source refuses plans
    that need nothing but the unparsed text, such as a count of bad lines.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .filter(F.trim("value") != "")
    )
    parsed = F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("_p"), "file").select("_p.*", "file")


def read_signal_tree(spark: SparkSession, base: str, schema: T.StructType | str, file_level: bool = False) -> DataFrame:
    """All zones and signals of a landing tree in one scan, labelled from the path."""
    return read_jsonl(spark, base, schema, file_level).withColumns(path_columns(F.col("file")))


def quarantine(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, pattern: str = "*.json*"
) -> DataFrame:
    """The unreadable lines and their files."""
    return read_jsonl_with_corrupt(spark, path, schema, pattern).filter(F.col(CORRUPT).isNotNull()).select(
        "file", F.col(CORRUPT).alias("line")
    )


def _csv_fields(line: Column) -> Column:
    """The fields of one CSV line as an array, quotes resolved; an empty field is null."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*)'), F.lit(1))
    plain = lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(parts, lambda x: F.nullif(plain(x), F.lit("")))


# Stands in no text, so that the CSV source gives whole lines.
NO_SEPARATOR = "\x01\x02\x01"


def _csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """file, its header (the first line that is not blank) and _columns, the names in it.

    The lines of a file may be read by several tasks: the first one is the least by (block, order in the task).
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
        .filter(F.trim("value") != "")
    )
    first = lines.groupBy("file").agg(F.min_by("value", F.struct("_block", "_at")).alias("header"))
    names = _csv_fields(F.regexp_replace("header", "^\ufeff", ""))
    return first.withColumn("_columns", F.transform(names, lambda c: F.coalesce(F.trim(c), F.lit(""))))


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and _line, every line that is neither blank nor its file's header, which the CSV source itself leaves out."""
    return (
        spark.read.schema("_line string")
        .options(header="true", sep=NO_SEPARATOR, quote="", escape="", pathGlobFilter="*.csv", recursiveFileLookup="true")
        .csv(path)
        .select(F.col("_metadata.file_path").alias("file"), "_line")
        .filter(F.trim("_line") != "")
    )


def csv_quarantine(spark: SparkSession, path: str, required: str = "time") -> DataFrame:
    """file and header of the CSV files that have no ``required`` column."""
    return _csv_headers(spark, path).filter(~F.array_contains("_columns", required)).select("file", "header")


def read_csv_folder(spark: SparkSession, path: str, required: str = "time", columns: Sequence[str] | None = None) -> DataFrame:
    """All CSV files below ``path`` by column name, as text, with ``file`` and ``_columns``.

    Columns may stand in any order, quoted or not, and differ between files; a column that a file
    lacks is null. Large files are split over tasks: lines meet the header of their file in a join with one row per file.
    ``columns`` names the wanted ones; without it a first scan collects the distinct names, never the files.
    Files without the ``required`` column are left out and listed by :func:`csv_quarantine`. A quoted line break is
    not supported.
    """
    headers = _csv_headers(spark, path).filter(F.array_contains("_columns", required)).drop("header")
    if columns is None:
        columns = sorted(r["c"] for r in headers.select(F.explode("_columns").alias("c")).distinct().collect())
    if not columns:
        raise FileNotFoundError(f"no readable CSV files in {path}")
    split = _csv_lines(spark, path).join(headers, "file").withColumn("_fields", _csv_fields(F.col("_line")))

    def field(name: str) -> Column:
        at = F.array_position("_columns", F.lit(name))
        return F.when(at > 0, F.get("_fields", (at - 1).cast("int")))

    return split.select(*[field(c).alias(c) for c in columns], "file", "_columns")


def folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def tag_zone(df: DataFrame, folders: DataFrame) -> DataFrame:
    """Add the zone of each row from its folder; ``folders`` maps folder to zone."""
    return df.withColumn("folder", folder_of(F.col("file"))).join(folders, "folder").drop("folder")


def newest_files(df: DataFrame, by: Sequence[str], file: str = "file") -> DataFrame:
    """Rows of the file with the greatest name per group.

    The file list is an aggregate, pre-reduced per task; rows meet it in a semi join.
    """
    newest = df.groupBy(*by).agg(F.max(file).alias(file))
    return df.join(newest, [*by, file], "left_semi")


def weather_payload_rows(df: DataFrame, payload: str, features: Mapping[str, str], source_tz: str = "UTC") -> DataFrame:
    """One row per hour from ``{"hourly": {"time": […], <feature>: […], …}}``.

    ``features`` maps names to types. Wall-clock times are read in ``source_tz``.
    Payloads without hours give no rows.
    """
    arrays = ", ".join([f"`{f}`: array<{kind}>" for f, kind in features.items()])
    schema = f"struct<hourly: struct<`time`: array<string>, {arrays}>>"
    rest = [c for c in df.columns if c != payload]
    parsed = df.select(*rest, F.from_json(payload, schema).alias("_p"))
    zipped = F.arrays_zip(F.col("_p.hourly.time"), *[F.col(f"_p.hourly.{f}") for f in features])
    rows = parsed.select(*rest, F.inline(zipped))
    return rows.withColumn("time", local_to_utc(F.col("time"), source_tz))


def envelope_rows(df: DataFrame, payload: str, record: str) -> DataFrame:
    """One row per record of ``{"data": [ … ]}``; without ``data`` the object is the record."""
    rest = [c for c in df.columns if c != payload]
    parsed = df.select(
        *rest,
        F.from_json(payload, f"struct<data: array<struct<{record}>>>").alias("_e"),
        F.from_json(payload, f"struct<{record}>").alias("_self"),
    )
    return parsed.select(*rest, F.inline(F.coalesce(F.col("_e.data"), F.array("_self"))))
