"""Reading, checking, streaming, exporting and keeping query logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from sqltraffic.schema import LOG_ENTRY

CORRUPT = "_corrupt_record"
_READ = T.StructType([*LOG_ENTRY, T.StructField(CORRUPT, T.StringType())])
#: What a missing key stands for.
DEFAULTS = {"session_id": 0, "source_ip": "", "user": "", "database": "", "query_type": "", "query": "", "response_time_ms": 0.0, "rows_affected": 0, "rows_returned": 0, "error": ""}


def _clean(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT).na.fill(DEFAULTS)


#: Where a line stands: its file, the block of the file that was read at once, and its place among what that task read.
PLACE = ("file", "block", "place")


def read_query_log(spark: SparkSession, path: str, placed: bool = False, longest: int | None = None) -> DataFrame:
    """A log of JSON lines, compressed or not. A malformed line is left out whole; unknown keys are ignored.

    With `placed`, the columns PLACE tell the lines' order, however the files are split. With `longest`, a line of more bytes fails
    the read; without it such lines are read like all others.
    """
    if longest is None:
        rows = spark.read.schema(_READ).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    else:
        lines = spark.read.text(path)
        fits = F.when(F.octet_length("value") <= longest, F.col("value")).otherwise(F.raise_error(F.concat(F.lit(f"a line of more than {longest} bytes in "), F.col("_metadata.file_name"))))
        rows = lines.select(*_places(placed), F.from_json(fits, _READ, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("entry")).where("entry is not null")
        return _clean(rows.select("entry.*", *(PLACE if placed else ())))
    return _clean(rows.select("*", *_places(placed)))


def _places(placed: bool) -> list[Column]:
    columns = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return [c.alias(n) for c, n in zip(columns, PLACE, strict=True)] if placed else []


def log_quality(spark: SparkSession, path: str, longest: int = 16 << 20) -> DataFrame:
    """Per file: lines, good and malformed ones, and those longer than `longest` bytes."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")
    parsed = lines.withColumn("entry", F.from_json("value", _READ, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}))
    good = F.col("entry").isNotNull() & F.col(f"entry.{CORRUPT}").isNull()
    return parsed.groupBy("file_name").agg(
        F.count("*").alias("lines"), F.count_if(good).alias("good"), F.count_if(~good).alias("malformed"), F.count_if(F.octet_length("value") > longest).alias("too_long")
    )


def list_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of the files below a path, one row each; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "modificationTime")


def pending_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are not completed, in order of name; one in progress starts anew."""
    return listing.join(manifest.where("status = 'completed'"), "file_name", "left_anti").orderBy("file_name")


def advance_manifest(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest (file_name, status, lines) with the files in `done` (file_name, lines) completed."""
    kept = manifest.join(done, "file_name", "left_anti").select("file_name", "status", "lines")
    return kept.unionByName(done.select("file_name", F.lit("completed").alias("status"), "lines"))


def stream_query_log(spark: SparkSession, directory: str, files_per_trigger: int = 1, after: str = "off", archive: str | None = None) -> DataFrame:
    """The log's files as a stream, a few at a time. `after`: off, delete or archive (then with a folder)."""
    reader: DataStreamReader = spark.readStream.schema(_READ).option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", files_per_trigger).option("cleanSource", after)
    return _clean((reader.option("sourceArchiveDir", archive) if archive else reader).json(directory))


def export_query_log(events: DataFrame, redact_args: bool = False) -> DataFrame:
    """Query events in the log's schema; times are cut to whole microseconds."""
    args = F.transform("args", lambda _: F.lit("<redacted>")) if redact_args else F.col("args")
    return events.withColumns({"args": args, "response_time_ms": F.floor(F.col("response_time_ms") * 1000.0) / 1000.0, "error": F.coalesce("error", F.lit(""))}).select(
        *[F.col(f.name).cast(f.dataType) for f in LOG_ENTRY]
    )


def write_query_log(log: DataFrame, path: str, rows_per_file: int = 1_000_000, compression: str = "none") -> None:
    """JSON lines of at most so many to a file, in a folder for each day."""
    dated = log.withColumn("date", F.to_date("timestamp"))
    dated.write.option("maxRecordsPerFile", rows_per_file).option("compression", compression).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").partitionBy("date").mode("append").json(path)


#: Spark's setting that takes extremes of a partition column from the folders' names alone.
BY_NAMES = "spark.sql.optimizer.metadataOnly"


def newest_day(log: DataFrame) -> DataFrame:
    """The latest `date`; over a log in day folders no file is read for it."""
    return log.agg(F.max("date").alias("date"))


def retain_log(log: DataFrame, max_age_days: int) -> DataFrame:
    """The log's latest days; older folders are not read."""
    spark = log.sparkSession
    before = spark.conf.get(BY_NAMES)
    spark.conf.set(BY_NAMES, "true")
    try:
        newest = newest_day(log).first()["date"]
    finally:
        spark.conf.set(BY_NAMES, before)
    return log.where(F.col("date") > F.date_sub(F.lit(newest).cast("date"), max_age_days))
