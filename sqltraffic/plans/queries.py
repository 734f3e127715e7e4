"""One query per operator, over what Spark derives from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltraffic.functions import statements
from sqltraffic.operators import compare, gates, metrics, replay, sessions, sketches, stats
from sqltraffic.operators.compare import CompareOptions
from sqltraffic.plans import fixtures, oracle
from sqltraffic.scratch import scratch_dir
from sqltraffic.sources import query_log as logs
from sqltraffic.sources import reports
from sqltraffic.streaming import jobs, kept, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
IGNORE = ["now\\(\\)"]
DAY = 86_400
ALLOW, EXCLUDE = ["10.0.0.0/15"], ["10.0.1.0/25"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query; counts and numbers come out as longs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes])

    QUERIES[f.__name__] = run
    return f


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixtures.result_pairs(spark, sf_dir)
    return stats.with_digest(compare.compare_results(pairs, CompareOptions(ignore_queries=IGNORE, time_threshold_ms=1.0)))


def captured(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    return compare.compare_results(fixtures.captured_pairs(spark, sf_dir), CompareOptions(**options))


def funnel(log: DataFrame) -> DataFrame:
    return gates.gate_funnel(log, True, 0.75, ALLOW, EXCLUDE, F.col("event_id"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.digest_summary(compared(spark, sf_dir))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log in the log's own schema."""
    log = fixtures.query_log(spark, sf_dir)
    return log.select(
        F.col("ts").alias("timestamp"), "session_id", "source_ip", "user", "database", "query_type", "query", F.array(F.col("event_id").cast("string"), F.lit("x")).alias("args"),
        "response_time_ms", F.lit(0).cast("long").alias("rows_affected"), F.lit(0).cast("long").alias("rows_returned"), "error",
    )


def written_log(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "log")
    logs.write_query_log(log_entries(spark, sf_dir), path)
    return path


def in_batches(spark: SparkSession, df: DataFrame, by: str, files: int = 3, close: int | None = None, last: dict[str, object] | None = None, late: Column | None = None, end: int | None = None) -> tuple[DataFrame, str]:
    """A table as a stream that arrives in files, in order of a time column; and a folder for checkpoints.

    The files are written one after another, since a stream takes them by their age. With `close`, a last file has
    one row so many seconds after the end, of nulls but for what `last` gives, which takes the watermark past all others.
    A join drops rows of a null key on its inner side before the watermark sees them, so `last` must give those keys there.
    With `end` (microseconds), the stream is open until then even if its own rows end before, or if it has none: of two
    streams the slower one holds the watermark.
    Rows that are `late` come in a file of their own after that, and another closing one between: a batch's late rows are
    told by the watermark of the batch before it, which is that of the rows one batch further back.
    """
    path = scratch_dir(spark, "stream")
    ends = df.agg(F.unix_micros(F.min(by)).alias("low"), F.unix_micros(F.max(by)).alias("high")).first()
    closes = [t for t in (ends["high"], end) if t is not None]
    low, high = (ends["low"] or 0, max(closes, default=0))  # no times: files without rows
    span = (high - low) // files + 1
    held = F.lit(False) if late is None else F.coalesce(late, F.lit(False))
    for i in range(files):
        df.where((F.floor((F.unix_micros(by) - low) / span) == i) & ~held).coalesce(1).write.mode("append").parquet(path)
    if close is not None and closes:
        values = {c: F.lit(v) for c, v in (last or {}).items()} | {by: F.timestamp_micros(F.lit(high + close * 1_000_000))}
        for _ in range(1 if late is None else 2):
            spark.range(1).select(*[values.get(c, F.lit(None)).cast(df.schema[c].dataType).alias(c) for c in df.columns]).coalesce(1).write.mode("append").parquet(path)
    if late is not None:
        df.where(held).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), scratch_dir(spark, "checkpoint")


def drained(stream: DataFrame, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream puts out, once it has read what there is."""
    out, schema = f"{checkpoint}-out", stream.schema
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={number}'}")
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    return found


# --- sources and sinks -----------------------------------------------------------------------
@query
def s1_read_query_log(spark, sf_dir):
    return logs.read_query_log(spark, written_log(spark, sf_dir)).drop("date").withColumn("args", F.array_join("args", ","))


@query
def s2_log_quality(spark, sf_dir):
    path = written_log(spark, sf_dir)
    log_entries(spark, sf_dir).limit(1).select(F.lit("{not json").alias("value")).write.text(f"{path}/date=2000-01-01")
    return logs.log_quality(spark, path).agg(*[F.sum(c).alias(c) for c in ("lines", "good", "malformed", "too_long")])


def _listing(spark, sf_dir):
    days = fixtures.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("lines"))
    name = F.concat(F.lit("queries-"), F.date_format("d", "yyyy-MM-dd"), F.lit(".jsonl"))
    status = F.when(F.dayofmonth("d") % 2 == 1, "completed").otherwise("in_progress")
    return days.select(name.alias("file_name"), "lines", status.alias("status"))


@query
def s3_pending_files(spark, sf_dir):
    files = _listing(spark, sf_dir)
    return logs.pending_files(files.select("file_name"), files)


@query
def s3_advance_manifest(spark, sf_dir):
    files = _listing(spark, sf_dir)
    return logs.advance_manifest(files, files.where("status != 'completed'").select("file_name", "lines"))


@query
def s4_stream_query_log(spark, sf_dir):
    path = scratch_dir(spark, "log")
    log_entries(spark, sf_dir).repartition(3).write.option("timestampFormat", reports.STAMP).json(path)
    stream = logs.stream_query_log(spark, path)
    return drained(stream, scratch_dir(spark, "checkpoint")).groupBy("session_id").agg(F.count("*").alias("n"))


@query
def s5_write_diff_report(spark, sf_dir):
    path = scratch_dir(spark, "report")
    reports.write_diff_report(compared(spark, sf_dir), path)
    schema = "query string, session_id long, match boolean, differences array<struct<type:string,original:string,replay:string>>"
    listed = F.array_join(F.transform("differences", lambda d: F.concat_ws("|", d["type"], d["original"], d["replay"])), ";")
    return spark.read.schema(schema).json(path).select("query", "session_id", "match", listed.alias("differences"))


@query
def s6_write_digest_summary(spark, sf_dir):
    path = scratch_dir(spark, "summary")
    reports.write_digest_summary(summary(spark, sf_dir), path)
    return spark.read.schema("digest string, count long, diff_count long, overhead_avg_ms double").json(path)


@query
def s7_retain_log(spark, sf_dir):
    path = scratch_dir(spark, "log")
    log = fixtures.query_log(spark, sf_dir)
    log.withColumn("date", F.to_date("ts")).write.partitionBy("date").option("compression", "gzip").json(path)
    kept = spark.read.schema("session_id long, seq long, query string, date date").json(path)
    return logs.retain_log(kept, 7).drop("date")


@query
def s8_export_query_log(spark, sf_dir):
    return logs.export_query_log(log_entries(spark, sf_dir), redact_args=True).select("timestamp", "session_id", "user", "database", "query", "response_time_ms", "error", F.array_join("args", ",").alias("args"))


# --- projections and filters -----------------------------------------------------------------
KEYS = ["session_id", "seq"]


@query
def p1_digest_catalog(spark, sf_dir):
    return gates.digest_catalog(fixtures.query_log(spark, sf_dir))


@query
def p1_deep_digests(spark, sf_dir):
    """Lists nested as deep as an event's number, up to some hundreds: all of a kind have one digest."""
    n = (F.col("event_id") % 400 + 1).cast("int")
    log = fixtures.query_log(spark, sf_dir).where("event_id % 10 = 0")
    deep = F.concat(F.lit("SELECT "), F.col("session_id").cast("string"), F.lit(" FROM t WHERE id IN "), F.repeat(F.lit("("), n), F.lit("1"), F.repeat(F.lit(")"), n), F.lit(" AND kind = 'k"), (F.col("event_id") % 3).cast("string"), F.lit("'"))
    return log.groupBy(statements.digest(deep, exact=True).alias("digest")).agg(F.count("*").alias("count"))


@query
def p2_statement_mix(spark, sf_dir):
    return gates.statement_mix(fixtures.query_log(spark, sf_dir))


@query
def p3_replayable_reads(spark, sf_dir):
    return gates.replayable_reads(fixtures.query_log(spark, sf_dir)).select(*KEYS, "query")


@query
def p4_session_safe(spark, sf_dir):
    return gates.session_safe(fixtures.query_log(spark, sf_dir)).select(*KEYS, "query")


@query
def p5_mark_ignored(spark, sf_dir):
    return gates.mark_ignored(fixtures.query_log(spark, sf_dir), IGNORE).select(*KEYS, "ignored")


@query
def p6_gate_by_cidr(spark, sf_dir):
    return gates.gate_by_cidr(fixtures.query_log(spark, sf_dir), ALLOW, EXCLUDE).select(*KEYS, "source_ip")


@query
def p7_gate_by_sample(spark, sf_dir):
    return gates.gate_by_sample(fixtures.query_log(spark, sf_dir), 0.25, F.col("event_id")).select(*KEYS, "event_id")


@query
def p9_redact_args(spark, sf_dir):
    log = fixtures.query_log(spark, sf_dir).withColumn("args", F.array(F.col("event_id").cast("string"), F.lit("x")))
    return gates.redact_args(log).select(*KEYS, F.array_join("args", ",").alias("args"))


@query
def p10_redact_diffs(spark, sf_dir):
    return compare.exploded(captured(spark, sf_dir, redact_columns=["o_orderstatus"]), "query_id")


@query
def p11_normalize_source(spark, sf_dir):
    return gates.normalize_source(fixtures.query_log(spark, sf_dir)).select(*KEYS, "source_ip")


@query
def p12_write_targets(spark, sf_dir):
    return gates.write_targets(fixtures.query_log(spark, sf_dir))


@query
def p13_temp_table_lifetimes(spark, sf_dir):
    return sessions.temp_table_lifetimes(fixtures.query_log(spark, sf_dir))


@query
def p14_stringify_table(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "supplier").select("s_suppkey", F.encode("s_name", "utf-8").alias("s_name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("s_nationkey"))
    return compare.stringify_table(rows)


@query
def p15_classify_errors(spark, sf_dir):
    return compare.classify_errors(fixtures.query_log(spark, sf_dir))


@query
def p16_flag_slow(spark, sf_dir):
    return compare.flag_slow(compare.result_timing(fixtures.result_pairs(spark, sf_dir)), 1.0).select(*KEYS, "time_diff_exceeded")


@query
def p17_emit_filter(spark, sf_dir):
    return compare.emit_filter(compared(spark, sf_dir)).select(*KEYS, F.get("differences", F.lit(0))["type"].alias("type"))


@query
def p18_attach_user(spark, sf_dir):
    return compare.attach_user(compared(spark, sf_dir)).select(*KEYS, "user")


# --- joins -----------------------------------------------------------------------------------
def _replies(spark, sf_dir):
    return fixtures.result_pairs(spark, sf_dir).where("event_id % 19 != 0").select(*KEYS, "replay_ms", "ts")


@query
def j1_pair_results(spark, sf_dir):
    return compare.pair_results(fixtures.query_log(spark, sf_dir), _replies(spark, sf_dir).drop("ts")).select(*KEYS, "query", "replay_ms")


@query
def j2_diff_tables(spark, sf_dir):
    primary, other = fixtures.captured_cells(spark, sf_dir)
    return compare.diff_tables(primary, other, "query_id", ["o_orderkey"], fixtures.COLUMNS)


@query
def j2_diff_whole_tables(spark, sf_dir):
    """Tables without a key: the other side has some statuses changed, and lacks the last row."""
    rows = fixtures.table(spark, sf_dir, "orders").select(*fixtures.COLUMNS)
    last = rows.agg(F.max("o_orderkey").alias("last"))
    status = F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus"))
    other = rows.join(F.broadcast(last)).where("o_orderkey != last").drop("last").withColumn("o_orderstatus", status)
    return compare.diff_tables(rows, other, None, ["o_orderkey"], fixtures.COLUMNS)


@query
def j3_cidr_join(spark, sf_dir):
    n = F.col("s_suppkey")
    nets = fixtures.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("net"), (n % 8).cast("string")).alias("name"), F.concat(F.lit("10.0."), (n % 8).cast("string"), F.lit(".0/"), (24 + n % 3).cast("string")).alias("cidr")
    ).distinct()
    return gates.cidr_join(fixtures.query_log(spark, sf_dir), nets).select(*KEYS, "name")


@query
def j5_asof_policy(spark, sf_dir):
    return gates.asof_policy(fixtures.query_log(spark, sf_dir), fixtures.policies(spark, sf_dir)).select(*KEYS, "enabled", "sample_rate")


@query
def j6_admitted_digests(spark, sf_dir):
    results = compared(spark, sf_dir)
    return stats.admitted_only(results, stats.digest_cap(results, 4)).select(*KEYS, "digest")


@query
def j7_replay_compare(spark, sf_dir):
    reads = [
        "SELECT n_name FROM {nation} ORDER BY n_nationkey", "SELECT r_name, count(*) AS n FROM {region} JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name ORDER BY r_name", "SELECT s_name FROM {supplier} ORDER BY s_suppkey",
        "SELECT n_name, 100 DIV part AS share FROM {nation} ORDER BY n_name", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} ORDER BY l_orderkey, l_linenumber",
    ]
    primary = {t: fixtures.table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "lineitem")}
    quantity = F.when(F.col("l_partkey") % 100 == 0, -1).otherwise(F.col("l_quantity")).cast(primary["lineitem"].schema["l_quantity"].dataType)
    second = {"nation": primary["nation"].withColumn("n_name", F.when(F.col("n_nationkey") == 3, "CHANGED").otherwise(F.col("n_name"))), "region": primary["region"], "lineitem": primary["lineitem"].withColumn("l_quantity", quantity)}
    primary["nation"], second["nation"] = primary["nation"].withColumn("part", F.col("n_nationkey") + 1), second["nation"].withColumn("part", F.col("n_nationkey"))
    outcomes, _ = replay.replay_compare(spark, reads, primary, second)
    return outcomes.select("query", "match", F.col("n").alias("n_differences"), F.get("types", F.lit(0)).alias("type"))


# --- aggregations ----------------------------------------------------------------------------
@query
def a1_comparison_totals(spark, sf_dir):
    return stats.comparison_totals(compared(spark, sf_dir))


@query
def a2_digest_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query
def a3_digest_cap(spark, sf_dir):
    return stats.digest_cap(compared(spark, sf_dir), 4)


@query
def a3_cap_overflow(spark, sf_dir):
    return stats.cap_overflow(stats.digest_cap(compared(spark, sf_dir), 4))


@query
def a4_diff_breakdown(spark, sf_dir):
    return compare.diff_breakdown(captured(spark, sf_dir))


@query
def a5_gate_funnel(spark, sf_dir):
    return funnel(fixtures.query_log(spark, sf_dir))


@query
def a6_latency_stats(spark, sf_dir):
    return stats.latency_stats(fixtures.timings(spark, sf_dir))


@query
def a7_latency_overhead(spark, sf_dir):
    return stats.latency_overhead(stats.latency_stats(fixtures.timings(spark, sf_dir)))


@query
def a8_traffic_summary(spark, sf_dir):
    return stats.traffic_summary(fixtures.query_log(spark, sf_dir)).withColumn("total_ms", F.round("total_ms", 3))


@query
def a9_session_summary(spark, sf_dir):
    return stats.session_summary(fixtures.query_log(spark, sf_dir))


@query
def a10_regressions(spark, sf_dir):
    return stats.regressions(compared(spark, sf_dir)).withColumn("avg_diff_ms", F.round("avg_diff_ms", 6))


@query
def a11_metric_snapshot(spark, sf_dir):
    log = fixtures.query_log(spark, sf_dir)
    return metrics.metric_snapshot(log, compared(spark, sf_dir), funnel(log), sessions.lifetime_audit(log, 1_000_000.0), max_digests=4)


@query
def a12_metrics_by_cluster(spark, sf_dir):
    found = metrics.metrics_by_cluster(fixtures.cluster_metrics(spark, sf_dir))
    return found.withColumn("value", F.when(F.col("name") == "queries_total", F.col("value")).otherwise(F.round("value", 6)))


@query
def a13_diff_fraction(spark, sf_dir):
    return metrics.diff_fraction(compared(spark, sf_dir))


@query
def a14_unique_digests(spark, sf_dir):
    return stats.unique_digests(fixtures.query_log(spark, sf_dir))


@query
def a15_reservoir_sample(spark, sf_dir):
    return stats.reservoir_sample(stats.with_digest(fixtures.query_log(spark, sf_dir)), 100).groupBy("digest").agg(F.count("*").alias("sampled"))


# --- order within sessions, and time ---------------------------------------------------------
@query
def w1_sessionize(spark, sf_dir):
    return sessions.sessionize(fixtures.query_log(spark, sf_dir).drop("seq"), "event_id").select("session_id", "event_id", "seq")


@query
def w1_file_order(spark, sf_dir):
    """Statements whose times are told to the hour alone keep their lines' order, file by file."""
    path = scratch_dir(spark, "log")
    log = fixtures.query_log(spark, sf_dir).select(F.date_trunc("hour", "ts").alias("timestamp"), F.to_date("ts").alias("date"), "session_id", "query", F.col("event_id").alias("rows_returned"))
    log.repartition("date").sortWithinPartitions("date", "rows_returned").write.partitionBy("date").option("timestampFormat", reports.STAMP).json(path)
    read = logs.read_query_log(spark, path, placed=True, longest=1 << 20).withColumnRenamed("timestamp", "ts")
    return sessions.sessionize(read, *logs.PLACE).select("session_id", F.col("rows_returned").alias("event_id"), "seq")


@query
def w2_replay_schedule(spark, sf_dir):
    plan = sessions.replay_schedule(fixtures.query_log(spark, sf_dir), 20000.0)
    return plan.select(*KEYS, F.round("wait_ms", 6).alias("wait_ms"), F.round("offset_ms", 6).alias("offset_ms"))


@query
def w3_temp_table_gate(spark, sf_dir):
    return sessions.temp_table_gate(fixtures.query_log(spark, sf_dir)).select(*KEYS, "passes")


@query
def w4_current_database(spark, sf_dir):
    log = fixtures.query_log(spark, sf_dir)
    use = F.concat(F.lit("USE `other"), (F.col("event_id") % 3).cast("string"), F.lit("`"))
    return sessions.current_database(log.withColumn("query", F.when(F.col("event_id") % 11 == 0, use).otherwise(F.col("query")))).select(*KEYS, "in_force")


@query
def w5_heartbeats(spark, sf_dir):
    return metrics.heartbeats(compared(spark, sf_dir), 60)


@query
def w6_counter_rates(spark, sf_dir):
    return metrics.counter_rates(fixtures.cluster_metrics(spark, sf_dir))


@query
def w7_active_sessions(spark, sf_dir):
    return metrics.active_sessions(fixtures.query_log(spark, sf_dir))


@query
def w8_teardown_effect(spark, sf_dir):
    return sessions.teardown_effect(fixtures.query_log(spark, sf_dir)).select(*KEYS, "dropped")


@query
def w8_replay_timeouts(spark, sf_dir):
    pairs = fixtures.result_pairs(spark, sf_dir)
    return sessions.teardown_effect(pairs.withColumn("error", F.col("replay_error")), timeout_ms=200.0).select(*KEYS, "dropped")


@query
def w9_transaction_spans(spark, sf_dir):
    return sessions.transaction_spans(fixtures.query_log(spark, sf_dir))


@query
def w10_lifetime_audit(spark, sf_dir):
    return sessions.lifetime_audit(fixtures.query_log(spark, sf_dir), 1_000_000.0)


@query
def t1_rank_digests(spark, sf_dir):
    return stats.rank_digests(summary(spark, sf_dir))


@query
def t2_top_k(spark, sf_dir):
    return stats.top_k(summary(spark, sf_dir), "diff_count", 5).select("digest", "diff_count")


@query
def t3_summary_report(spark, sf_dir):
    return stats.summary_report(summary(spark, sf_dir))


# --- comparison ------------------------------------------------------------------------------
@query
def c1_compare_results(spark, sf_dir):
    return compare.exploded(captured(spark, sf_dir), "query_id")


@query
def c1_matches(spark, sf_dir):
    return captured(spark, sf_dir).select("query_id", "match")


def long_pairs(spark, sf_dir):
    """The captured pairs without their rows, and their differences by the long form."""
    pairs = fixtures.captured_pairs(spark, sf_dir)
    meta = pairs.withColumns({"n_original": F.size("original_rows"), "n_replay": F.size("replay_rows")}).drop("original_rows", "replay_rows")
    return meta, compare.long_differences(meta, compare.cells_of(pairs, "query_id", "original"), compare.cells_of(pairs, "query_id", "replay"), "query_id")


@query
def c2_compare_long(spark, sf_dir):
    return long_pairs(spark, sf_dir)[1].drop("position")


@query
def c2_difference_counts(spark, sf_dir):
    meta, found = long_pairs(spark, sf_dir)
    return compare.difference_counts(meta, found, "query_id").withColumn("types", F.array_join("types", ","))


@query
def c2_difference_pages(spark, sf_dir):
    pages = compare.difference_pages(long_pairs(spark, sf_dir)[1], "query_id", rows=4)
    return pages.select("query_id", "page", "n", F.size("differences").alias("listed"), F.get("differences", F.lit(0))["type"].alias("first_type"), F.get("differences", F.lit(0))["row"].alias("first_row"))


@query
def c2_first_differences(spark, sf_dir):
    return compare.first_differences(long_pairs(spark, sf_dir)[1], "query_id", n=2, rows=4).drop("position")


@query
def c3_result_timing(spark, sf_dir):
    return compare.result_timing(fixtures.result_pairs(spark, sf_dir)).select(*KEYS, "original_time_ms", "replay_time_ms", "time_diff_ms")


@query
def c4_schema_diff(spark, sf_dir):
    return compare.schema_diff(fixtures.captured_pairs(spark, sf_dir), "query_id")


@query
def c5_column_drift(spark, sf_dir):
    return compare.column_drift(captured(spark, sf_dir))


@query
def c6_offline_compare(spark, sf_dir):
    pairs = fixtures.result_pairs(spark, sf_dir)
    log = pairs.select(*KEYS, "query", "original_error", "original_affected", "original_ms")
    reads = statements.category(F.col("query")) == statements.SELECT
    one = F.array(F.lit("id"))
    other = pairs.select(*KEYS, "replay_error", "replay_affected", "replay_ms", F.when(reads, one).otherwise(F.array().cast("array<string>")).alias("replay_columns"), "replay_rows")
    types = F.array_join(F.transform("differences", lambda d: d["type"]), ",")
    return compare.offline_compare(log, other).select(*KEYS, F.nullif(types, F.lit("")).alias("types"))


@query
def u1_combined_report(spark, sf_dir):
    results = compared(spark, sf_dir)
    rows = compare.emit_filter(results).select(F.lit("difference").alias("type"), *KEYS)
    return metrics.combined_report(rows, metrics.heartbeats(results, 86_400).select("type", "timestamp", "window_total"))


# --- streaming -------------------------------------------------------------------------------
@query
def x1_stream_digest_counts(spark, sf_dir):
    stream, checkpoint = in_batches(spark, fixtures.query_log(spark, sf_dir), "ts")
    found = drained(jobs.stream_digest_counts(stream), checkpoint, "complete")
    return found.select("digest", "count", F.round("avg_ms", 9).alias("avg_ms"))


#: A closing row as late as this, and as long as an interval, after the end takes the watermark just past the last interval.
LATE = 600


@query
def x2_stream_heartbeats(spark, sf_dir):
    stream, checkpoint = in_batches(spark, compared(spark, sf_dir).select("ts", "ignored", "match"), "ts", close=3600 + LATE)
    with stateful.timed_state(spark):
        return drained(stateful.stream_heartbeats(stream, 3600), checkpoint)


@query
def x3_stream_summary(spark, sf_dir):
    stream, checkpoint = in_batches(spark, fixtures.query_log(spark, sf_dir), "ts")
    return drained(jobs.stream_summary(stream), checkpoint, "complete")


@query
def x3_stream_digest_table(spark, sf_dir):
    rows = compared(spark, sf_dir).select("ts", "digest", "match", "differences", "original_time_ms", "replay_time_ms")
    stream, checkpoint = in_batches(spark, rows, "ts")
    found = drained(jobs.stream_digest_table(stream), checkpoint, "complete")
    return found.select("digest", "count", "match_count", "diff_count", "error_count", *[F.round(f"{s}_avg_ms", 9).alias(f"{s}_avg_ms") for s in ("original", "replay")])


@query
def x3_stream_sketches(spark, sf_dir):
    """Counts are exact; of the percentiles and distinct sessions, whether they are as near as the sketches promise."""
    rows = compared(spark, sf_dir).select("ts", "digest", "session_id", "match", "differences", "original_time_ms", "replay_time_ms")
    stream, checkpoint = in_batches(spark, rows, "ts")
    kept.stream_sketches(stream, checkpoint, f"{checkpoint}-sketches").awaitTermination()
    found = sketches.sketch_summary(sketches.merged(spark.read.parquet(f"{checkpoint}-sketches"), "digest"))
    sides = [(s, p) for s in ("original", "replay") for p in (95, 99)]
    asked = rows.join(found.select("digest", "n_sessions", *[f"{s}_p{p}_ms" for s, p in sides]), "digest")
    # A rank of p lies between the shares of values below the one that was read, and up to it.
    near = [((F.avg((F.col(f"{s}_time_ms") < F.col(f"{s}_p{p}_ms")).cast("int")) <= p / 100 + 0.02) & (F.avg((F.col(f"{s}_time_ms") <= F.col(f"{s}_p{p}_ms")).cast("int")) >= p / 100 - 0.02)).alias(f"{s}_p{p}_near") for s, p in sides]
    exact = asked.groupBy("digest").agg(*near, (F.abs(F.max("n_sessions") / F.count_distinct("session_id") - 1) < 0.1).alias("sessions_near"))
    return found.select("digest", *sketches.COUNTS, F.round("original_avg_ms", 6).alias("original_avg_ms")).join(exact, "digest")


@query
def x4_stream_session_gate(spark, sf_dir):
    stream, checkpoint = in_batches(spark, fixtures.query_log(spark, sf_dir), "ts")
    return drained(jobs.stream_session_gate(stream), checkpoint)


def _replies_stream(spark, sf_dir):
    """Replies a second after their statements, as a stream that ends with the log, whichever statements of the end have one."""
    replies = _replies(spark, sf_dir).select(*KEYS, "replay_ms", (F.col("ts") + F.expr("interval 1 second")).alias("replay_ts"))
    end = fixtures.table(spark, sf_dir, "events").agg(F.unix_micros(F.max("ts")).alias("end")).first()["end"]
    return in_batches(spark, replies, "replay_ts", close=DAY, last={"session_id": -1, "seq": -1}, end=end)[0]


def stream_paired(spark, sf_dir):
    """All statements with their replays, those of the end too; the closing rows are taken out."""
    primary, checkpoint = in_batches(spark, fixtures.query_log(spark, sf_dir), "ts", close=DAY)
    other = _replies_stream(spark, sf_dir)
    paired = drained(jobs.stream_pair(primary.select(*KEYS, "event_id", "ts"), other), checkpoint)
    return paired.where("event_id is not null").drop("event_id")


@query
def x5_stream_pair(spark, sf_dir):
    return stream_paired(spark, sf_dir).select(*KEYS, "replay_ms")


@query
def x7_stream_digest_cap(spark, sf_dir):
    stream, checkpoint = in_batches(spark, fixtures.query_log(spark, sf_dir), "ts")
    jobs.stream_digest_cap(stream, f"{checkpoint}-admitted", 4, checkpoint, f"{checkpoint}-out").awaitTermination()
    return spark.read.schema("digest string, batch long").parquet(f"{checkpoint}-out").groupBy("digest").agg(F.count("*").alias("count"))


@query
def x8_stream_policy(spark, sf_dir):
    stream, checkpoint = in_batches(spark, fixtures.query_log(spark, sf_dir), "ts")
    jobs.stream_policy(stream, lambda: fixtures.policies(spark, sf_dir), "event_id", checkpoint, f"{checkpoint}-out").awaitTermination()
    return spark.read.schema("session_id long, seq int, batch long").parquet(f"{checkpoint}-out").select(*KEYS)


@query
def x9_stream_report(spark, sf_dir):
    """Differences, as they come, and heartbeats of days, in one report of committed batches."""
    rows = compared(spark, sf_dir).select(*KEYS, "ts", "ignored", "match", F.get("differences", F.lit(0))["type"].alias("kind"))
    stream, checkpoint = in_batches(spark, rows, "ts", close=DAY + LATE)
    differences = compare.emit_filter(stream).select(F.lit("difference").alias("type"), *KEYS, "kind")
    beats = stateful.stream_heartbeats(stream, DAY).select("type", "timestamp", "window_total", "cumulative_differed")
    with stateful.timed_state(spark):
        kept.stream_report(differences.unionByName(beats, allowMissingColumns=True), checkpoint, f"{checkpoint}-report").awaitTermination()
    return kept.read_report(spark, f"{checkpoint}-report", "type string, session_id long, seq long, kind string, timestamp timestamp, window_total long, cumulative_differed long")


@query
def x10_stream_sample(spark, sf_dir):
    log = stats.with_digest(fixtures.query_log(spark, sf_dir)).select("digest", *KEYS, "ts", "response_time_ms")
    stream, checkpoint = in_batches(spark, log, "ts")
    by = F.conv(F.substring(F.md5(F.concat_ws(":", *KEYS)), 1, 15), 16, 10).cast("long")
    kept.stream_sample(stream, by, KEYS, 20, checkpoint, f"{checkpoint}-sample").awaitTermination()
    return kept.read_sample(spark, f"{checkpoint}-sample").select("digest", *KEYS, "response_time_ms")


@query
def x11_late_rows(spark, sf_dir):
    """Some statements of the first third come when the log is over: the session gate drops them, and the drops are counted."""
    log = fixtures.query_log(spark, sf_dir)
    ends = log.agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    low, high = (ends["low"] or 0, ends["high"] or 0)
    third = F.unix_micros("ts") - low <= (high - low) // 3
    stream, checkpoint = in_batches(spark, log, "ts", close=3600 + LATE, last={"session_id": -1, "seq": 1, "event_id": -1, "query": "SELECT 1"}, late=third & (F.col("event_id") % 97 == 0))
    late = kept.LateRows()
    spark.streams.addListener(late)
    try:
        drained(jobs.stream_session_gate(stream), checkpoint)
        late.ended()
    finally:
        spark.streams.removeListener(late)
    dropped = F.coalesce(F.sum("value"), F.lit(0.0))
    return late.table(spark).agg(dropped.alias("value")).select(F.lit("late_rows_dropped").alias("name"), F.lit("counter").alias("kind"), "value")


@query
def x12_stream_replayed(spark, sf_dir):
    columns = [*KEYS, "ts", "query", "source_ip", "event_id"]
    log, checkpoint = in_batches(spark, fixtures.query_log(spark, sf_dir).select(*columns), "ts", close=DAY, last={"session_id": -1, "seq": 1, "event_id": -1, "query": "SELECT 1", "source_ip": ""})
    other = _replies_stream(spark, sf_dir)
    gate = (F.col("event_id") < 0) | (gates.sample_point(F.col("event_id")) < 0.75) & gates.cidr_passes(F.col("source_ip"), ALLOW, EXCLUDE)
    with stateful.timed_state(spark):
        found = drained(stateful.stream_replayed(log, other, gate), checkpoint)
    return found.where("session_id >= 0").select(*KEYS, "replay_ms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
