"""Structured Streaming forms of the batch operators. `log` is a stream with the log's columns and ts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sqltraffic.functions import statements
from sqltraffic.operators import gates
from sqltraffic.operators.stats import digest_cap


def stream_digest_counts(log: DataFrame) -> DataFrame:
    """Counts and means by digest, for update or complete mode. Percentiles: percentile_approx, whose state is bounded."""
    return log.groupBy(statements.digest(F.col("query")).alias("digest")).agg(
        F.count("*").alias("count"), F.avg("response_time_ms").alias("avg_ms"), F.percentile_approx("response_time_ms", [0.95, 0.99], 1000).alias("p95_p99_ms")
    )


def stream_summary(log: DataFrame) -> DataFrame:
    """Running totals, for complete mode."""
    digest = statements.digest(F.col("query"))
    return log.agg(F.count("*").alias("total"), F.count_if(F.col("error") != "").alias("errors"), F.approx_count_distinct(digest, 0.01).alias("digests"))


def stream_digest_table(results: DataFrame) -> DataFrame:
    """The summary's table so far, by digest, for complete or update mode (digest, match, differences and both times).

    Percentiles are percentile_approx, whose state is bounded; stats.digest_summary over the sink has exact ones.
    """
    has_error = F.exists("differences", lambda d: d["type"] == "error")
    times = [f(f"{s}_time_ms").alias(f"{s}_{n}_ms") for s in ("original", "replay") for n, f in (("avg", F.avg), ("p95_p99", lambda c: F.percentile_approx(c, [0.95, 0.99], 1000)))]
    return results.groupBy("digest").agg(
        F.count("*").alias("count"), F.count_if("match").alias("match_count"), F.count_if(~F.col("match")).alias("diff_count"), F.count_if(has_error).alias("error_count"), *times
    )


GATED = "session_id long, seq long, passes boolean"


def stream_session_gate(log: DataFrame, late: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """The temporary-table gate with each session's tables kept from batch to batch (append mode).

    State is the session's own table names, no more. A session is forgotten once the watermark has passed its last statement by `idle_ms`:
    time is that of the log, so a stream of what there is comes to an end, and a replay forgets what the first run forgot.
    """
    query = F.col("query")
    kind = statements.category(query)
    safe = [statements.SELECT, statements.SESSION_STATE, statements.TEMP_TABLE, statements.TRANSACTION]
    rows = log.withWatermark("ts", late).select(
        "session_id", "ts", F.col("seq").cast("long").alias("seq"), kind.isin(safe).alias("safe"), kind.isin(statements.DML, statements.DDL).alias("write"),
        statements.temp_created(query).alias("created"), statements.temp_dropped(query).alias("dropped"),
        statements.write_target(query).alias("target"), statements.is_plain_drop(query).alias("plain_drop"),
    )

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tables = set(state.get[0].split("\n")) - {""} if state.exists else set()
        out = []
        batch = pd.concat(frames).sort_values("seq")
        for row in batch.itertuples():
            passes = row.safe or (row.write and row.target in tables)
            if row.created:
                tables.add(row.created)
            elif row.dropped:
                tables.discard(row.dropped)
            elif row.plain_drop and passes:
                tables.discard(row.target)
            out.append((key[0], row.seq, bool(passes)))
        state.update(("\n".join(sorted(tables)),))
        last = int(batch["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "seq", "passes"])

    return rows.groupBy("session_id").applyInPandasWithState(gate, GATED, "tables string", "append", GroupStateTimeout.EventTimeTimeout)


def stream_pair(primary: DataFrame, replay: DataFrame, timeout: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Statements with their replays; one that has none within the timeout comes out alone."""
    left = primary.withWatermark("ts", late)
    right = replay.select(F.col("session_id").alias("r_session"), F.col("seq").alias("r_seq"), "replay_ts", "replay_ms").withWatermark("replay_ts", late)
    within = F.expr(f"replay_ts >= ts AND replay_ts <= ts + interval {timeout}")
    return left.join(right, (F.col("session_id") == F.col("r_session")) & (F.col("seq") == F.col("r_seq")) & within, "left_outer").drop("r_session", "r_seq")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_digest_cap(log: DataFrame, table: str, max_digests: int, checkpoint: str, out: str) -> StreamingQuery:
    """Rows of the first `max_digests` digests. Those admitted are kept below `table`, a folder for each batch, so a batch run again writes the same."""

    def work(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.withColumn("digest", statements.digest(F.col("query")))
        known = spark.createDataFrame([], "digest string, batch long") if number == 0 else spark.read.schema("digest string, batch long").parquet(table)
        known = known.where(F.col("batch") < number).select("digest").distinct()
        room = max_digests - known.count()
        fresh = digest_cap(batch.join(known, "digest", "left_anti"), max_digests).where(F.col("rank") <= room).select("digest")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        admitted = known.unionByName(spark.read.schema("digest string").parquet(f"{table}/batch={number}"))
        batch.join(admitted, "digest", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(log, work, checkpoint)


def stream_policy(log: DataFrame, policy: Callable[[], DataFrame], key: str, checkpoint: str, out: str) -> StreamingQuery:
    """Rows that the policy in force at their time lets through, by its switch, networks and sample rate; the policy table is read anew in each batch."""

    def work(batch: DataFrame, number: int) -> None:
        ruled = gates.asof_policy(batch, policy()).where("enabled")
        inside = gates.policy_cidr_passes(F.col("source_ip"), F.col("allow"), F.col("exclude"))
        ruled.where(inside & (gates.sample_point(F.col(key)) < F.col("sample_rate"))).drop("allow", "exclude").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return each_batch(log, work, checkpoint)
