"""Writing difference reports and digest summaries as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltraffic.operators.compare import emit_filter

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def report_rows(results: DataFrame, log_matches: bool = False) -> DataFrame:
    """The report's fields; row 0, an empty column, user or list, and a false `ignored` are left out as nulls."""
    rows = emit_filter(results, log_matches)
    lean = F.transform("differences", lambda d: F.struct(d["type"].alias("type"), F.nullif(d["row"], F.lit(0)).alias("row"), F.nullif(d["column"], F.lit("")).alias("column"), d["original"].alias("original"), d["replay"].alias("replay")))
    user = F.when(~F.col("match") & ~F.col("ignored"), F.nullif("user", F.lit("")))
    return rows.select(
        "query", F.col("digest").alias("query_digest"), "session_id", user.alias("user"), F.col("ts").alias("timestamp"), "match",
        F.when(F.col("ignored"), True).alias("ignored"), F.when(F.size("differences") > 0, lean).alias("differences"),
        "original_time_ms", "replay_time_ms", "time_diff_ms", "time_diff_exceeded",
    )


def write_diff_report(results: DataFrame, path: str, log_matches: bool = False) -> None:
    report_rows(results, log_matches).write.mode("append").option("timestampFormat", STAMP).json(path)


def write_digest_summary(summary: DataFrame, path: str) -> None:
    """In order of rank, over as many files as the sort makes; their names keep the order."""
    summary.orderBy(F.desc("count"), "digest").write.mode("overwrite").json(path)
