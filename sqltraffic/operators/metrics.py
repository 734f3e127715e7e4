"""Reports over time, and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names and kinds of the exposed metrics that tables can tell.
METRICS = {
    "active_sessions": "gauge",
    "total_sessions": "counter",
    "sessions_closed_max_lifetime": "counter",
    "sessions_lifetime_postponed": "counter",
    "queries_handled": "counter",
    "query_errors": "counter",
    "shadow_enabled": "gauge",
    "shadow_active_sessions": "gauge",
    "shadow_queries_replayed": "counter",
    "shadow_disabled": "counter",
    "shadow_sampled_out": "counter",
    "shadow_filtered_by_cidr": "counter",
    "shadow_skipped": "counter",
    "shadow_dropped": "counter",
    "comparisons_total": "counter",
    "comparisons_matched": "counter",
    "comparisons_differed": "counter",
    "comparisons_ignored": "counter",
    "comparisons_digest_count": "gauge",
    "comparisons_digest_overflow": "counter",
}


def beat_counts() -> list[Column]:
    """A beat's counts of compared statements (ignored, match)."""
    kinds = {"total": F.count("*"), "matched": F.count_if(~F.col("ignored") & F.col("match")), "differed": F.count_if(~F.col("ignored") & ~F.col("match")), "ignored": F.count_if("ignored")}
    return [f.alias(f"window_{n}") for n, f in kinds.items()]


def heartbeats(results: DataFrame, seconds: int) -> DataFrame:
    """Per interval from the first to the last: its counts, and running totals. Idle intervals count too.

    Only the intervals' own rows are ordered in one place: there are as many as beats, not as results.
    """
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    found = results.groupBy(start.alias("timestamp")).agg(*beat_counts())
    ends = found.agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).where("low is not null")
    beats = ends.select(F.explode(F.sequence("low", "high", F.expr(f"interval {seconds} seconds"))).alias("timestamp"))
    out = beats.join(found, "timestamp", "left").na.fill(0)
    return running_totals(out, "timestamp").withColumns({"type": F.lit("heartbeat"), "window_seconds": F.lit(seconds)})


def running_totals(beats: DataFrame, by: str) -> DataFrame:
    """Heartbeats (window_total, window_differed), streamed or not, with what has been counted up to each."""
    so_far = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return beats.withColumns({f"cumulative_{n}": F.sum(f"window_{n}").over(so_far) for n in ("total", "differed")})


def combined_report(results: DataFrame, beats: DataFrame) -> DataFrame:
    """Difference records and heartbeats as one table of two shapes."""
    return results.unionByName(beats, allowMissingColumns=True)


def metric_snapshot(log: DataFrame, results: DataFrame, funnel: DataFrame, audit: DataFrame, enabled: bool = True, max_digests: int = 10_000, idle_seconds: int = 3600) -> DataFrame:
    """The metrics that tables can tell, at the log's end, as rows (name, kind, value).

    `results` are compared statements with their digest and the replay's error; `funnel` is what gates.gate_funnel gives and `audit`
    what sessions.lifetime_audit gives. A session is active until it has been idle for `idle_seconds`; its replay is, while that is enabled.
    Replays after the first transport error of their session were dropped; those that have neither this nor an error were replayed.
    """
    from .sessions import teardown_effect
    from .stats import cap_overflow, comparison_totals, digest_cap

    each = log.groupBy("session_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.count_if(F.col("error") != "").alias("failed"))
    end = each.agg(F.max("last").alias("end"))
    open_still = F.col("last") >= F.col("end") - F.expr(f"interval {idle_seconds} seconds")
    replays = teardown_effect(results.select("session_id", "seq", F.col("replay_error").alias("error")))
    reasons = {"disabled": "disabled", "sampled_out": "sampled_out", "cidr": "filtered_by_cidr", "skipped": "skipped"}
    active, nothing = F.count_if(open_still), F.lit(0)
    tables = [
        each.join(F.broadcast(end)).agg(
            active.alias("active_sessions"), F.count("*").alias("total_sessions"), F.coalesce(F.sum("n"), nothing).alias("queries_handled"), F.coalesce(F.sum("failed"), nothing).alias("query_errors"),
            (active * int(enabled)).alias("shadow_active_sessions"), F.lit(int(enabled)).alias("shadow_enabled"),
        ),
        audit.agg(F.count("closed_at").alias("sessions_closed_max_lifetime"), F.count_if("postponed").alias("sessions_lifetime_postponed")),
        funnel.agg(*[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("count"))), nothing).alias(f"shadow_{name}") for r, name in reasons.items()]),
        replays.agg(F.count_if(~F.col("dropped") & (F.col("error") == "")).alias("shadow_queries_replayed"), F.count_if("dropped").alias("shadow_dropped")),
        comparison_totals(results).select(*[F.col(c).alias(f"comparisons_{c}") for c in ("total", "matched", "differed", "ignored")]),
        cap_overflow(digest_cap(results, max_digests)).select(F.col("admitted").alias("comparisons_digest_count"), F.col("overflow").alias("comparisons_digest_overflow")),
    ]
    out = None
    for one in tables:
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(METRICS[c]).alias("kind"), F.col(c).cast("double").alias("value")) for c in one.columns])
        rows = one.select(F.explode(cells).alias("m")).select("m.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def metrics_by_cluster(metrics: DataFrame) -> DataFrame:
    """Counters summed and gauges averaged, per cluster and over all (`*`). A name that has both kinds is two metrics."""
    value = F.when(F.col("kind") == "counter", F.sum("value")).otherwise(F.avg("value"))
    sets = [[F.col("cluster"), F.col("name"), F.col("kind")], [F.col("name"), F.col("kind")]]
    grouped = metrics.groupingSets(sets, "cluster", "name", "kind").agg(F.grouping("cluster").alias("_all"), value.alias("value"))
    return grouped.select(F.when(F.col("_all") == 1, "*").otherwise(F.col("cluster")).alias("cluster"), "name", "value")


def diff_fraction(results: DataFrame, width: str = "1 hour") -> DataFrame:
    found = results.groupBy(F.window("ts", width)["start"].alias("bucket")).agg(F.count("*").alias("total"), F.count_if(~F.col("ignored") & ~F.col("match")).alias("differed"))
    return found.withColumn("fraction", F.try_divide(F.col("differed").cast("double"), F.col("total")))


def counter_rates(metrics: DataFrame) -> DataFrame:
    """Counters as rates per second; after a reset the new value is the growth."""
    w = Window.partitionBy("cluster", "name").orderBy("ts")
    before, seconds = F.lag("value").over(w), (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6
    grown = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    return metrics.where("kind = 'counter'").withColumn("rate", F.try_divide(grown, seconds)).where("rate is not null").select("ts", "cluster", "name", "rate")


def active_sessions(log: DataFrame) -> DataFrame:
    """How many sessions are open from each moment on at which one begins or has ended.

    Moments of one day are summed first, so that a day's order is one task's work, and days are put together after.
    """
    ends = log.groupBy("session_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    steps = ends.select(F.explode(F.array(F.struct(F.col("first").alias("ts"), F.lit(1).alias("step")), F.struct(F.col("last").alias("ts"), F.lit(-1).alias("step")))).alias("e")).select("e.*")
    moments = steps.groupBy("ts").agg(F.sum("step").alias("step")).withColumn("day", F.to_date("ts"))
    days = moments.groupBy("day").agg(F.sum("step").alias("step"))
    base = days.select("day", F.coalesce(F.sum("step").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.sum("step").over(Window.partitionBy("day").orderBy("ts"))
    return moments.withColumn("inside", inside).join(base, "day").select("ts", (F.col("base") + F.col("inside")).alias("active"))
