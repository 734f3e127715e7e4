"""The streamed session gate: state from batch to batch, its end, and idle sessions."""

from pyspark.sql import functions as F

from sqltraffic.streaming import jobs

LOG = "session_id long, seq long, ts timestamp, query string"
STEPS = [
    (1, 1, 0, "CREATE TEMPORARY TABLE scratch (a int)"), (2, 1, 0, "CREATE TEMPORARY TABLE scratch (a int)"), (1, 2, 1, "INSERT INTO scratch VALUES (1)"), (3, 1, 1, "INSERT INTO scratch VALUES (1)"),
    (1, 3, 60, "DROP TEMPORARY TABLE scratch"), (1, 4, 61, "INSERT INTO scratch VALUES (1)"), (3, 2, 60 * 24 * 5, "SELECT 1"), (3, 3, 60 * 24 * 5 + 1, "SELECT 1"), (2, 2, 60 * 24 * 5 + 2, "INSERT INTO scratch VALUES (1)"),
]
EXPECTED = {(1, 1): True, (2, 1): True, (1, 2): True, (3, 1): False, (1, 3): True, (1, 4): False, (3, 2): True, (3, 3): True, (2, 2): False}


def test_gate_over_batches(spark, tmp_path):
    """Each file is a batch of its own. Session 2 is idle for five days, so its table is forgotten; the stream ends by itself."""
    path = str(tmp_path / "log")
    for low, high in ((0, 4), (4, 6), (6, 7), (7, 8), (8, 9)):
        rows = spark.createDataFrame([(s, q, m, text) for s, q, m, text in STEPS[low:high]], "session_id long, seq long, m long, query string")
        rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("m"))).select("session_id", "seq", "ts", "query").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    jobs.stream_session_gate(stream).writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    assert {(r["session_id"], r["seq"]): r["passes"] for r in spark.read.parquet(out).collect()} == EXPECTED
