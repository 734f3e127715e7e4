"""Query logs, results, captured pairs, timings and metrics that Spark derives from the given tables.

They stand in for what a traffic recorder would have written; each has a SQL twin in oracle.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Times without a zone become instants, for the functions that need them.
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def _pick(n: str, *choices: object):
    """The choice numbered by column n."""
    return F.element_at(F.array(*[c if not isinstance(c, str) else F.lit(c) for c in choices]), (F.col(n) + 1).cast("int"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({f"m{k}": F.col("event_id") % k for k in (3, 4)})
    text = F.col("event_id").cast("string")
    scratch = F.concat(F.lit("scratch_"), _pick("m3", "a", "b", "c"))
    create = F.concat(F.lit("CREATE TEMPORARY TABLE "), scratch, F.lit(" (id INT)"))
    query = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("SELECT * FROM pages WHERE user_id = "), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit("/* trace="), text, F.lit(" */ SELECT id FROM items WHERE id IN (1, 2, "), text, F.lit(")")))
        .when(F.col("event_type") == "signup", F.when(F.col("event_id") % 2 == 0, create).otherwise(F.concat(F.lit("DROP TEMPORARY TABLE "), scratch)))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("INSERT INTO "), _pick("m4", "scratch_a", "scratch_b", "scratch_c", "sales"), F.lit(" VALUES ("), text, F.lit(", 'it''s')")))
        .otherwise(_pick("m4", "BEGIN", "COMMIT", F.concat(F.lit("UPDATE items SET n = "), text, F.lit(" WHERE id = 7")), "SELECT NOW()"))
    )
    error = F.when(F.col("event_type") == "error", _pick("m3", "ERROR 1146 (42S02): no table", "i/o timeout: connection was bad", "")).otherwise("")
    address = F.concat(F.lit("10.0."), (F.col("user_id") % 8).cast("string"), F.lit("."), (F.col("event_id") % 250).cast("string"), F.lit(":"), (40000 + F.col("event_id") % 1000).cast("string"))
    return e.select(
        "ts",
        F.col("user_id").alias("session_id"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"),
        F.when(F.col("event_id") % 101 == 0, "").otherwise(address).alias("source_ip"),
        F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("user"),
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("database"),
        F.when(F.col("m4") == 0, "execute").otherwise("query").alias("query_type"),
        query.alias("query"),
        F.col("value").alias("response_time_ms"),
        error.alias("error"),
        "event_id",
    )


def result_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log with both sides' errors, affected rows and times; no columns or rows."""
    none = F.array().cast("array<string>")
    return query_log(spark, sf_dir).withColumns({
        "original_error": F.col("error"),
        "replay_error": F.when(F.col("event_id") % 13 == 0, F.when(F.col("error") == "", "ERROR 1064 (42000): syntax").otherwise("")).otherwise(F.col("error")),
        "original_affected": F.col("event_id") % 5,
        "replay_affected": F.col("event_id") % 5 + (F.col("event_id") % 17 == 0).cast("long"),
        "original_ms": F.col("response_time_ms"),
        "replay_ms": F.col("response_time_ms") + ((F.col("event_id") % 7) - 3) / 2.0,
        "original_columns": none,
        "replay_columns": none,
        "original_rows": F.array().cast("array<array<string>>"),
        "replay_rows": F.array().cast("array<array<string>>"),
    })


COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]


def captured_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows before they are gathered: query_id and the three columns as text."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), *COLUMNS)
    status = F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus"))
    return o, o.where("o_orderkey % 50 != 0").withColumn("o_orderstatus", status)


def captured_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per customer, both sides' results nested."""
    primary, replay = captured_cells(spark, sf_dir)

    def gathered(rows: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.col(c).cast("string") for c in COLUMNS])
        return rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", cells.alias("cells")))), lambda r: r["cells"]).alias(side))

    both = gathered(primary, "original_rows").join(gathered(replay, "replay_rows"), "query_id", "left")
    rows = F.coalesce("replay_rows", F.array().cast("array<array<string>>"))
    names = F.array(*[F.lit(c) for c in COLUMNS])
    short, renamed, failed = F.col("query_id") % 37 == 0, F.col("query_id") % 41 == 0, F.col("query_id") % 31 == 0
    replay_names = F.when(short, F.slice(names, 1, 2)).when(renamed, F.array(F.lit("o_orderkey"), F.lit("status"), F.lit("o_orderpriority"))).otherwise(names)
    return both.select(
        "query_id",
        names.alias("original_columns"),
        F.when(failed, F.array().cast("array<string>")).otherwise(replay_names).alias("replay_columns"),
        "original_rows",
        F.when(failed, F.array().cast("array<array<string>>")).when(short, F.transform(rows, lambda r: F.slice(r, 1, 2))).otherwise(rows).alias("replay_rows"),
        F.lit("").alias("original_error"),
        F.when(failed, "ERROR 1146 (42S02): no table").otherwise("").alias("replay_error"),
        F.lit(0).cast("long").alias("original_affected"),
        F.lit(0).cast("long").alias("replay_affected"),
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "direct").otherwise("proxy").alias("path"),
        F.col("l_returnflag").alias("query"),
        (F.col("l_quantity").cast("long") * 1000 + F.col("l_suppkey")).alias("duration_ns"),
        F.when(F.col("l_partkey") % 211 == 0, "failed").otherwise("").alias("error"),
    )


def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counts of events per hour and cluster, and a gauge of the hour's distinct users."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("ts"), (F.col("user_id") % 2).cast("string").alias("cluster"), "user_id")
    hours = e.groupBy("ts", "cluster").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    hours = hours.withColumn("running", F.sum("n").over(Window.partitionBy("cluster").orderBy("ts")))
    return hours.select("ts", "cluster", F.explode(F.array(
        F.struct(F.lit("queries_total").alias("name"), F.lit("counter").alias("kind"), F.col("running").cast("double").alias("value")),
        F.struct(F.lit("sessions_active").alias("name"), F.lit("gauge").alias("kind"), F.col("users").cast("double").alias("value")),
    )).alias("m")).select("ts", "cluster", "m.*")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate policies that change in the log's time, some within a day: one for each third day of events, by its number."""
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("valid_from")).distinct()
    n = F.dayofmonth("valid_from")
    return days.where(n % 3 == 1).select(
        (F.col("valid_from") + F.when(n % 2 == 1, F.expr("interval 10 hours 30 minutes")).otherwise(F.expr("interval 0 hours"))).alias("valid_from"),
        (n % 4 != 0).alias("enabled"),
        F.when(n % 2 == 0, 0.5).otherwise(1.0).alias("sample_rate"),
        F.when(n % 4 == 1, F.array(F.lit("10.0.0.0/22"))).otherwise(F.array().cast("array<string>")).alias("allow"),
        F.when(n % 2 == 1, F.array(F.lit("10.0.3.0/24"))).alias("exclude"),
    )
