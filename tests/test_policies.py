"""Policies that start within a day."""

from pyspark.sql import functions as F

from sqltraffic.operators import gates


def test_policy_that_starts_at_noon(spark):
    log = spark.createDataFrame([(i,) for i in range(4)], "n int").withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 10 * n)"))
    policy = spark.sql("SELECT timestamp'2024-01-01 12:00:00' valid_from, true enabled, 0.5D sample_rate UNION ALL SELECT timestamp'2024-01-02 02:00:00', false, 1D")
    assert {(r["n"], r["enabled"]) for r in gates.asof_policy(log, policy).collect()} == {(0, None), (1, None), (2, True), (3, False)}
