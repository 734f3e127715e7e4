"""Digest summaries from sketches that can be merged: by hour and digest, over any parts of a log.

A KLL sketch holds a side's times: a rank read from it is off by at most about `1.7 / k` of all values with odds of 99 %, after any number of merges; its size
does not grow with the values. An HLL sketch holds the sessions. Counts, sums and extremes are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a KLL sketch keeps at its base; Spark's own is 200.
KLL = 400
SIDES = ("original", "replay")
COUNTS = ("count", "match_count", "diff_count", "error_count")


def sketch_hours(results: DataFrame, k: int = KLL) -> DataFrame:
    """One row per hour and digest. Needs ts, digest, session_id, match, differences and both times. Null times are in no sketch."""
    has_error = F.exists("differences", lambda d: d["type"] == "error")
    counts = {"count": F.count("*"), "match_count": F.count_if("match"), "diff_count": F.count_if(~F.col("match")), "error_count": F.count_if(has_error)}
    times = [f(F.col(f"{s}_time_ms")).alias(f"{s}_{n}") for s in SIDES for n, f in (("n", F.count), ("sum", F.sum), ("kll", lambda c: F.kll_sketch_agg_double(c, k)))]
    return results.groupBy(F.date_trunc("hour", "ts").alias("hour"), "digest").agg(*[c.alias(n) for n, c in counts.items()], *times, F.hll_sketch_agg("session_id").alias("sessions"))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of parts (batches, hours) as one row for each of `by`."""
    sums = [F.sum(c).alias(c) for c in (*COUNTS, *[f"{s}_{n}" for s in SIDES for n in ("n", "sum")])]
    return parts.groupBy(*by).agg(*sums, *[F.kll_merge_agg_double(f"{s}_kll").alias(f"{s}_kll") for s in SIDES], F.hll_union_agg("sessions").alias("sessions"))


def sketch_summary(merged_parts: DataFrame, points: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Counts, averages, percentiles and distinct sessions; a side without any time has nulls."""
    drop = [c for s in SIDES for c in (f"{s}_n", f"{s}_sum", f"{s}_kll")] + ["sessions"]
    new = {"n_sessions": F.hll_sketch_estimate("sessions")}
    for s in SIDES:
        there = F.col(f"{s}_n") > 0
        new[f"{s}_avg_ms"] = F.when(there, F.col(f"{s}_sum") / F.col(f"{s}_n"))
        new |= {f"{s}_p{round(100 * p)}_ms": F.when(there, F.kll_sketch_get_quantile_double(f"{s}_kll", F.lit(p))) for p in points}
    return merged_parts.withColumns(new).drop(*drop)
