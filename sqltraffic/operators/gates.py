"""Which statements go on to be replayed: class, pattern, network, sample and policy gates."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqltraffic.functions import network, statements


def digest_catalog(log: DataFrame) -> DataFrame:
    """Each digest with its first query, how often and from when to when it was seen."""
    rows = log.select(statements.digest(F.col("query")).alias("digest"), "query", "ts", "session_id", "seq")
    first = F.min(F.struct("ts", "session_id", "seq", "query"))
    return rows.groupBy("digest").agg(first["query"].alias("sample_query"), F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def statement_mix(log: DataFrame) -> DataFrame:
    return log.groupBy(statements.category(F.col("query")).alias("category"), "user", "database").agg(F.count("*").alias("count"))


def replayable_reads(log: DataFrame) -> DataFrame:
    return log.where(statements.category(F.col("query")) == statements.SELECT)


def session_safe(log: DataFrame) -> DataFrame:
    safe = [statements.SELECT, statements.SESSION_STATE, statements.TEMP_TABLE, statements.TRANSACTION]
    return log.where(statements.category(F.col("query")).isin(safe))


def checked_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern, if the engine that will run it can compile it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"not a regular expression: {pattern!r}: {e}") from None
    return pattern


def mark_ignored(results: DataFrame, patterns: list[str]) -> DataFrame:
    """`ignored` where a pattern matches anywhere in the query. A pattern that Spark's own regular expressions refuse is an error at once."""
    hit = F.lit(False)
    for p in patterns:
        checked_pattern(results.sparkSession, p)
        hit = hit | F.col("query").rlike(f"(?i){p}")
    return results.withColumn("ignored", hit)


def cidr_passes(source: Column, allow: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; no allow list allows all; an address that cannot be read passes."""
    address = network.host(source)
    allowed = network.inside_any(address, allow) if allow else F.lit(True)
    return F.coalesce(~network.inside_any(address, exclude) & allowed, F.lit(True))


def gate_by_cidr(log: DataFrame, allow: list[str], exclude: list[str]) -> DataFrame:
    return log.where(cidr_passes(F.col("source_ip"), allow, exclude))


def sample_point(key: Column) -> Column:
    """A number in [0, 1) that a key always gets."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def gate_by_sample(log: DataFrame, rate: float, key: Column | None = None) -> DataFrame:
    """Keep a share of the rows: by key, so that a rerun keeps the same; by chance without one."""
    if not 0 <= rate <= 1:
        raise ValueError("a sample rate lies between 0 and 1")
    return log.where((F.rand() if key is None else sample_point(key)) < rate)


def redact_args(log: DataFrame) -> DataFrame:
    return log.withColumn("args", F.transform("args", lambda _: F.lit("<redacted>")))


def normalize_source(log: DataFrame) -> DataFrame:
    return log.withColumn("source_ip", network.host(F.col("source_ip")))


def write_targets(log: DataFrame) -> DataFrame:
    rows = log.select(statements.write_target(F.col("query")).alias("target"), statements.category(F.col("query")).alias("category"))
    return rows.where(F.col("category").isin(statements.DML, statements.DDL)).groupBy("target", "category").agg(F.count("*").alias("count"))


def policy_cidr_passes(source: Column, allow: Column, exclude: Column) -> Column:
    """As cidr_passes, by lists that each row has of its own."""
    address = network.host(source)
    allowed = (F.coalesce(F.size(allow), F.lit(0)) <= 0) | network.inside_each(address, allow)
    return F.coalesce(~network.inside_each(address, exclude) & allowed, F.lit(True))


def cidr_join(log: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Rows of the log, with all their columns, and the `name` of each network (name, cidr) that holds their address.

    Every network is a prefix of bits, so a row is matched by equality with its own prefixes of the lengths
    that occur; the join is a hash join for tables of any size.
    """
    nets = cidrs.select(F.col("name").alias("net"), network.prefix(F.col("cidr")).alias("prefix")).where("prefix is not null")
    lengths = nets.groupBy().agg(F.collect_set(F.length("prefix")).alias("lengths"))  # 162 at most
    places = [f"c{i}" for i in range(len(log.columns))]  # so that no name of the log clashes
    rows = log.toDF(*places).withColumn("bits", network.bits(network.host(F.col(places[log.columns.index("source_ip")])))).where("bits is not null")
    own = F.array_distinct(F.transform("lengths", lambda n: F.substring("bits", F.lit(1), n)))  # longer ones than the address are all of it
    each = rows.join(F.broadcast(lengths)).select(*places, F.explode(own).alias("prefix"))
    return each.join(nets, "prefix").select(*[F.col(p).alias(c) for p, c in zip(places, log.columns, strict=True)], F.col("net").alias("name"))


def asof_policy(log: DataFrame, policy: DataFrame) -> DataFrame:
    """Each row with the policy in force at its time (valid_from and what else the policy table has), nulls before the first.

    A policy stands in each day of the log in which it is in force, so the join is by day, and the time is tested
    in the join: a row whose day has no policy yet at its time stays.
    """
    rules = [c for c in policy.columns if c != "valid_from"]
    span = policy.withColumn("until", F.lead("valid_from").over(Window.orderBy("valid_from")))
    last = F.coalesce("until", F.lit("9999-01-01").cast("timestamp"))
    ends = log.agg(F.date_trunc("day", F.max("ts")).alias("_end"))
    first = F.date_trunc("day", "valid_from")
    days = span.join(F.broadcast(ends)).where("valid_from < date_add(_end, 1)")
    days = days.withColumn("_of", F.explode(F.sequence(first, F.greatest(first, F.least(F.date_trunc("day", last), F.col("_end"))), F.expr("interval 1 day"))))
    days = days.select("_of", F.struct("valid_from", *rules).alias("_rule"), last.alias("_until"))
    rows = log.withColumn("_day", F.date_trunc("day", "ts"))
    in_force = (F.col("_day") == F.col("_of")) & (F.col("ts") >= F.col("_rule.valid_from")) & (F.col("ts") < F.col("_until"))
    return rows.join(days, in_force, "left").select(*[F.col(c) for c in log.columns], "_rule.*")


def gate_reason(enabled: Column, rate: Column | float, key: Column, allow: list[str], exclude: list[str], passes: Column) -> Column:
    """The first gate that stops a statement, in fixed order, or `eligible`."""
    return (
        F.when(~enabled, "disabled")
        .when(sample_point(key) >= rate, "sampled_out")
        .when(~cidr_passes(F.col("source_ip"), allow, exclude), "cidr")
        .when(~passes, "skipped")
        .otherwise("eligible")
    )


def gate_funnel(log: DataFrame, enabled: bool, rate: float, allow: list[str], exclude: list[str], key: Column) -> DataFrame:
    """Statements by the gate that stopped them."""
    safe = statements.category(F.col("query")).isin(statements.SELECT, statements.SESSION_STATE, statements.TEMP_TABLE, statements.TRANSACTION)
    return log.groupBy(gate_reason(F.lit(enabled), rate, key, allow, exclude, safe).alias("reason")).agg(F.count("*").alias("count"))
