"""Operators on the order of statements within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sqltraffic.functions import statements


def in_session() -> WindowSpec:
    return Window.partitionBy("session_id").orderBy("seq")


def earlier() -> WindowSpec:
    return in_session().rowsBetween(Window.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return in_session().rowsBetween(Window.unboundedPreceding, 0)


def sessionize(log: DataFrame, *ties: str) -> DataFrame:
    """`seq`: a statement's place in its session, by time and then by `ties` (file and place in it)."""
    order = Window.partitionBy("session_id").orderBy("ts", *ties)
    return log.withColumn("seq", F.row_number().over(order))


def replay_schedule(log: DataFrame, speed: float, longest_ms: float = 10_000.0) -> DataFrame:
    """Reads only, with the wait before each and its planned offset in the session.

    A wait is the gap to the read before, by speed; one of `longest_ms` or more, or of none, is no wait.
    """
    reads = log.where(statements.category(F.col("query")) == statements.SELECT)
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(in_session()))) / 1000.0
    wait = F.lit(0.0) if speed <= 0 else F.coalesce(F.when((gap / speed > 0) & (gap / speed < longest_ms), gap / speed), F.lit(0.0))
    return reads.withColumn("wait_ms", wait).withColumn("offset_ms", F.sum("wait_ms").over(so_far()))


def temp_table_gate(log: DataFrame) -> DataFrame:
    """`passes`: statements safe for a session, and writes to a temporary table that it has at that time."""
    kind, query = statements.category(F.col("query")), F.col("query")
    created, dropped, target = statements.temp_created(query), statements.temp_dropped(query), statements.write_target(query)
    plain_drop = statements.is_plain_drop(query)
    name = F.when(created != "", created).when(dropped != "", dropped).otherwise(target)
    event = F.when(created != "", True).when((dropped != "") | plain_drop, False)
    rows = log.withColumns({"_kind": kind, "_table": name, "_event": event})
    before = Window.partitionBy("session_id", "_table").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tracked = F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit(False)) & (F.col("_table") != "")
    safe = F.col("_kind").isin(statements.SELECT, statements.SESSION_STATE, statements.TEMP_TABLE, statements.TRANSACTION)
    write = F.col("_kind").isin(statements.DML, statements.DDL)
    return rows.withColumn("passes", safe | (write & tracked)).drop("_kind", "_table", "_event")


def temp_table_lifetimes(log: DataFrame) -> DataFrame:
    """For each CREATE of a temporary table: its table, when it began, and when the next event of it in the session ended it."""
    query = F.col("query")
    created, dropped = statements.temp_created(query), statements.temp_dropped(query)
    rows = log.select("session_id", "seq", "ts", F.when(created != "", created).otherwise(dropped).alias("table"), (created != "").alias("begins"))
    w = Window.partitionBy("session_id", "table").orderBy("seq")
    spans = rows.where("table != ''").withColumns({"ended": F.lead("ts").over(w), "dropped": ~F.lead("begins").over(w)})
    return spans.where("begins").select("session_id", "table", F.col("ts").alias("created"), "ended", F.coalesce("dropped", F.lit(False)).alias("dropped"))


def current_database(log: DataFrame) -> DataFrame:
    """`in_force`: the database of the last USE so far, else the row's own."""
    used = F.nullif(F.lower(F.translate(F.regexp_extract(statements.bare(F.col("query")), r"(?is)\AUSE\s+(`[^`]*`|[^\s;]+)", 1), "`", "")), F.lit(""))
    return log.withColumn("in_force", F.coalesce(F.last(used, ignorenulls=True).over(so_far()), "database"))


def is_transport_error(error: Column) -> Column:
    return (error != "") & ~error.rlike(r"(?i)\AERROR [0-9]+")


def teardown_effect(results: DataFrame, timeout_ms: float | None = None, time: str = "replay_ms") -> DataFrame:
    """`dropped`: statements after the first transport error of their session.

    With a timeout, a replay that took longer tears its session down too, and has no result itself: it and all after it are dropped.
    """
    late = F.coalesce(F.col(time) > timeout_ms, F.lit(False)) if timeout_ms is not None else F.lit(False)
    broken = F.coalesce(F.max(is_transport_error(F.col("error")) | late).over(earlier()), F.lit(False))
    return results.withColumn("dropped", broken | late)


def _in_transaction(log: DataFrame) -> DataFrame:
    text = F.upper(statements.bare(F.col("query")))
    edge = F.when(text.rlike(r"\A(?:BEGIN|START\s+TRANSACTION)(?:[\s;]|\z)"), True).when(text.rlike(r"\A(?:COMMIT|ROLLBACK)(?:[\s;]|\z)") & ~text.rlike(r"\AROLLBACK\s+TO"), False)
    return log.withColumn("_edge", edge).withColumn("in_transaction", F.coalesce(F.last("_edge", ignorenulls=True).over(so_far()), F.lit(False)))


def transaction_spans(log: DataFrame) -> DataFrame:
    """A row for each transaction of a session: where it begins, how many statements it has, whether it was ended."""
    rows = _in_transaction(log).withColumn("_span", F.sum(F.when(F.col("_edge"), 1).otherwise(0)).over(so_far()))
    was_in = F.coalesce(F.lag("in_transaction").over(in_session()), F.lit(False))
    rows = rows.withColumn("_ends", was_in & ~F.col("_edge")).where("in_transaction or _ends")
    return rows.groupBy("session_id", F.col("_span").alias("span")).agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("statements"), F.coalesce(F.bool_or("_ends"), F.lit(False)).alias("ended")
    )


def lifetime_audit(log: DataFrame, cap_seconds: float) -> DataFrame:
    """What a cap on session age would do. A session's deadline is the cap by a factor of 0.9 to 1.1 of its own.

    The first statement that ends past it outside a transaction closes the session; those inside one are postponed.
    """
    rows = _in_transaction(log).withColumn("_age", (F.unix_micros("ts") - F.unix_micros(F.min("ts").over(Window.partitionBy("session_id")))) / 1e6)
    point = F.conv(F.substring(F.md5(F.col("session_id").cast("string")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    deadline = F.lit(cap_seconds) * (0.9 + 0.2 * point)
    late = rows.withColumn("deadline", deadline).where(F.col("_age") >= F.col("deadline"))
    return late.groupBy("session_id").agg(
        F.min(F.when(~F.col("in_transaction"), F.col("seq"))).alias("closed_at"),
        F.min("seq").alias("first_late"),
    ).select("session_id", "first_late", "closed_at", (F.col("closed_at").isNull() | (F.col("closed_at") > F.col("first_late"))).alias("postponed"))
