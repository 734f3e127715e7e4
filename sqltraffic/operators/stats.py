"""Statistics over compared results and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltraffic.functions import statements
from sqltraffic.scratch import scratch_dir


def round2(x: Column) -> Column:
    """To two places, half away from zero, of x times 100."""
    return F.round(x * 100) / 100


def _slice(v: Column) -> Column:
    """A number that grows with v in steps of about a thousandth of v: an order's coarse part, at most some 40,000 for usual times."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    step = power * 1024 + F.floor(size / F.pow(F.lit(2.0), power) * 1024) + 2_097_152
    return F.when(v == 0, 0).when(F.isnan(v) | (v == float("inf")), 1 << 40).when(v == float("-inf"), -(1 << 40)).when(v > 0, step).otherwise(-step)


def nearest_ranks(rows: DataFrame, by: list[str], columns: list[str], points: dict[str, float]) -> DataFrame:
    """Exact percentiles by nearest rank, as `{column}_{point}`, of each group with a value that is not null."""
    return _ranks(_counted(rows, by, columns), by, columns, points)


def _counted(rows: DataFrame, by: list[str], columns: list[str], **more: Column) -> DataFrame:
    """The rows once for each of the columns: equal values of a group as one row, with their number `_n` and what else is aggregated."""
    kept = [c for c in rows.columns if c not in by]
    each = rows.select(*by, *kept, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_at", "_v"))
    return each.groupBy(*by, F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_at") + 1).alias("_of"), "_v").agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in more.items()])


def _ranks(counted: DataFrame, by: list[str], columns: list[str], points: dict[str, float]) -> DataFrame:
    """Slices of values are put in order by their counts, and only the slices that hold a wanted rank are ordered inside: no task
    holds or sorts a whole group, however many values it has."""
    keys = [*by, "_of"]
    counts = counted.where("_v is not null").select(*keys, "_v", "_n", _slice(F.col("_v")).alias("_slice"))
    group = Window.partitionBy(*keys)
    slices = counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_n")).select(
        *keys, "_slice", "_n", F.sum("_n").over(group).alias("_all"), (F.sum("_n").over(group.orderBy("_slice")) - F.col("_n")).alias("_before")
    )
    rank = {n: F.ceil(F.lit(p) * F.col("_all")) for n, p in points.items()}
    holds = [(r > F.col("_before")) & (r <= F.col("_before") + F.col("_n")) for r in rank.values()]
    wanted = slices.where(F.exists(F.array(*holds), lambda x: x)).select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate([*keys, "_slice"])], "_all", "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate([*keys, "_slice"])]
    inside = counts.join(wanted, same).withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_slice").orderBy("_v")))
    return inside.groupBy(*by).agg(*[F.min(F.when((F.col("_of") == c) & (F.col("_upto") >= r), F.col("_v"))).alias(f"{c}_{n}") for c in columns for n, r in rank.items()])


def _written(counted: DataFrame, name: str) -> DataFrame:
    """Counted values, written once: all statistics of a table come from them, and the table itself is read once."""
    spark, path = counted.sparkSession, scratch_dir(counted.sparkSession, name)
    counted.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(counted.schema).parquet(path)


def _with_ranks(found: DataFrame, counted: DataFrame, by: list[str], columns: list[str], points: dict[str, float]) -> DataFrame:
    """Groups with their percentiles; a group's key may be null."""
    ranks = _ranks(counted, by, columns, points)
    ranks = ranks.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    return found.join(ranks, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], "left").drop(*[f"_k{i}" for i in range(len(by))])


def comparison_totals(results: DataFrame) -> DataFrame:
    """total, matched, differed, ignored; an ignored row counts as nothing else."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("ignored") & F.col("match")).alias("matched"),
        F.count_if(~F.col("ignored") & ~F.col("match")).alias("differed"),
        F.count_if("ignored").alias("ignored"),
    )


def with_digest(results: DataFrame) -> DataFrame:
    return results.withColumn("digest", statements.digest(F.col("query")))


def digest_summary(results: DataFrame) -> DataFrame:
    """Counts, and time averages and nearest-rank percentiles of both sides, by digest.

    The overhead is the difference of the rounded figures. Needs digest, query, match, differences and both times. The results are read
    once: equal times of a digest are counted and written, and everything is worked out from that.
    """
    sides = {side: f"{side}_time_ms" for side in ("original", "replay")}
    rows = results.select("digest", *sides.values(), "query", F.struct("ts", "session_id", "seq").alias("at"), "match", F.exists("differences", lambda d: d["type"] == "error").alias("failed"))
    marks = {"matched": F.count_if("match"), "differed": F.count_if(~F.col("match")), "failed": F.count_if("failed"), "first": F.min(F.struct("at", "query"))}
    counted = _written(_counted(rows, ["digest"], list(sides.values()), **marks), "times")
    one = F.col("_of") == sides["original"]  # each result stands there once for each side
    of = lambda c: F.coalesce(F.sum(F.when(one, F.col(c))), F.lit(0))
    mean = lambda c: F.sum(F.when(F.col("_of") == c, F.col("_v") * F.col("_n"))) / F.sum(F.when((F.col("_of") == c) & F.col("_v").isNotNull(), F.col("_n")))
    totals = counted.groupBy("digest").agg(
        F.min("first")["query"].alias("sample_query"), of("_n").alias("count"), of("matched").alias("match_count"), of("differed").alias("diff_count"), of("failed").alias("error_count"),
        *[mean(c).alias(f"{c}_avg") for c in sides.values()],
    )
    ranked = _with_ranks(totals, counted, ["digest"], list(sides.values()), {"p95": 0.95, "p99": 0.99})
    times = [round2(F.col(f"{c}_{n}")).alias(f"{s}_{n}_ms") for s, c in sides.items() for n in ("avg", "p95", "p99")]
    found = ranked.select("digest", "sample_query", "count", "match_count", "diff_count", "error_count", *times)
    return found.withColumns({f"overhead_{n}_ms": round2(F.col(f"replay_{n}_ms") - F.col(f"original_{n}_ms")) for n in ("avg", "p95", "p99")})


def digest_cap(results: DataFrame, max_digests: int = 10_000) -> DataFrame:
    """Each digest by first arrival: its rank, count, and whether it is among the first `max_digests` (0 or less: the default)."""
    limit = max_digests if max_digests > 0 else 10_000
    first = results.groupBy("digest").agg(F.min(F.struct("ts", "session_id", "seq")).alias("first"), F.count("*").alias("count"))
    # Digests are ordered within the hour in which they first came; only hours are ordered in one place.
    hours = first.withColumn("_hour", F.date_trunc("hour", "first.ts"))
    sizes = hours.groupBy(F.col("_hour").alias("_of")).agg(F.count("*").alias("_n"))
    before = sizes.select("_of", (F.sum("_n").over(Window.orderBy("_of")) - F.col("_n")).alias("_before"))
    inside = hours.withColumn("_inside", F.row_number().over(Window.partitionBy("_hour").orderBy("first", "digest")))
    ranked = inside.join(before, F.col("_hour").eqNullSafe(F.col("_of"))).withColumn("rank", F.col("_before") + F.col("_inside"))
    return ranked.select("digest", "rank", "count", (F.col("rank") <= limit).alias("admitted"))


def cap_overflow(capped: DataFrame) -> DataFrame:
    """Digests admitted, and records of the others."""
    return capped.agg(F.count_if("admitted").alias("admitted"), F.coalesce(F.sum(F.when(~F.col("admitted"), F.col("count"))), F.lit(0)).alias("overflow"))


def admitted_only(results: DataFrame, capped: DataFrame) -> DataFrame:
    return results.join(capped.where("admitted").select("digest"), "digest", "left_semi")


def regressions(results: DataFrame) -> DataFrame:
    return results.groupBy("digest").agg(F.count_if("time_diff_exceeded").alias("exceeded"), F.max("time_diff_ms").alias("max_diff_ms"), F.avg("time_diff_ms").alias("avg_diff_ms"))


#: Shares in which a digest of very many rows is cut down before its rows meet.
SHARES = 256


def least_by(rows: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """At most k rows of each digest: those of least `by`, ties by the other columns. Samples of parts can be cut down together again."""
    cut = rows.withColumn("_share", F.pmod(F.xxhash64(by, *ties), F.lit(SHARES)))
    for w in (Window.partitionBy("digest", "_share"), Window.partitionBy("digest")):
        cut = cut.withColumn("_rank", F.row_number().over(w.orderBy(by, *ties))).where(F.col("_rank") <= k)
    return cut.drop("_share", "_rank")


def reservoir_sample(results: DataFrame, k: int = 10_000, seed: int | None = 0) -> DataFrame:
    """At most k rows of each digest, drawn evenly: those of the least hashes of their place and the seed."""
    by = F.rand() if seed is None else F.xxhash64("session_id", "seq", F.lit(seed))
    return least_by(results.withColumn("_by", by), k, "_by", "session_id", "seq").drop("_by")


def rank_digests(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("count"), "digest")


def top_k(summary: DataFrame, by: str, k: int) -> DataFrame:
    return summary.orderBy(F.desc(by), "digest").limit(k)


def summary_report(summary: DataFrame) -> DataFrame:
    """The display columns: digests cut to 58 characters, times with two decimals."""
    short = F.when(F.length("digest") > 58, F.concat(F.substring("digest", 1, 55), F.lit("..."))).otherwise(F.col("digest"))
    times = [F.format_string("%.2f", F.col(f"{s}_{n}_ms")).alias(f"{s}_{n}") for s in ("original", "replay") for n in ("avg", "p95", "p99")]
    return summary.select(short.alias("digest"), "count", "diff_count", "error_count", *times)


def unique_digests(log: DataFrame, approximate: bool = False) -> DataFrame:
    digest = statements.digest(F.col("query"))
    return log.agg((F.approx_count_distinct(digest) if approximate else F.countDistinct(digest)).alias("unique_digests"))


# --- latency ---------------------------------------------------------------------------------
def latency_stats(timings: DataFrame) -> DataFrame:
    """Per path and query: successes' count, average, percentiles, range, sample deviation; and errors. Whole nanoseconds.

    The timings are read once: equal durations are counted and written, and everything is worked out from that.
    """
    by = ["path", "query"]
    rows = timings.select(*by, F.when(F.col("error") == "", F.col("duration_ns")).alias("ok"), (F.col("error") != "").alias("failed"))
    counted = _written(_counted(rows, by, ["ok"], failed=F.count_if("failed")), "durations")
    n = F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0))
    means = counted.groupBy(*by).agg(n.alias("n"), F.try_divide(F.sum(F.col("_v") * F.col("_n")), n).alias("mean"), F.min("_v").cast("long").alias("min_ns"), F.max("_v").cast("long").alias("max_ns"), F.sum("failed").alias("errors"))
    means = means.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    spread = counted.join(means, same).groupBy(*by, "n", "mean", "min_ns", "max_ns", "errors").agg(F.sum((F.col("_v") - F.col("mean")) ** 2 * F.col("_n")).alias("squares"))
    deviation = F.sqrt(F.try_divide(F.col("squares"), F.col("n") - 1))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ranked = _with_ranks(spread, counted, by, ["ok"], points)
    return ranked.select(
        *by, "n", F.floor("mean").alias("avg_ns"), *[F.col(f"ok_{p}").cast("long").alias(f"{p}_ns") for p in points], "min_ns", "max_ns", F.floor(F.coalesce(deviation, F.lit(0.0))).alias("stddev_ns"), "errors"
    )


def latency_overhead(stats: DataFrame) -> DataFrame:
    """How much the proxy adds to p50 and p99, in percent, for queries that both paths have."""
    of = lambda path, c: F.max(F.when((F.col("path") == path) & (F.col("n") > 0), F.col(c)))
    both = stats.groupBy("query").agg(*[of(p, f"{c}_ns").alias(f"{p}_{c}") for p in ("direct", "proxy") for c in ("p50", "p99")]).where("direct_p50 is not null and proxy_p50 is not null")
    return both.select("query", *[((F.col(f"proxy_{c}") - F.col(f"direct_{c}")) * 100.0 / F.col(f"direct_{c}")).alias(f"{c}_overhead_pct") for c in ("p50", "p99")])


# --- traffic ---------------------------------------------------------------------------------
def traffic_summary(log: DataFrame) -> DataFrame:
    from sqltraffic.functions.network import host

    return log.groupBy("user", "database", "query_type", host(F.col("source_ip")).alias("source")).agg(
        F.count("*").alias("queries"), F.count_if(F.col("error") != "").alias("errors"), F.sum("response_time_ms").alias("total_ms")
    )


def session_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("age_seconds"),
        F.count("*").alias("queries"), F.count_if(F.col("error") != "").alias("errors"), F.countDistinct("user").alias("users"), F.countDistinct("database").alias("databases"),
    )
