"""Order and length of a log's lines."""

import json

import pytest
from pyspark.sql import functions as F

from sqltraffic.operators import sessions
from sqltraffic.sources import query_log as logs


def _write(folder, files):
    for name, rows in files.items():
        (folder / name).write_text("".join(json.dumps(r) + "\n" if isinstance(r, dict) else r + "\n" for r in rows))


def test_lines_keep_their_order_in_split_files(spark, tmp_path):
    """Two files of equal times, read in many small parts."""
    row = lambda f, i: {"timestamp": "2024-01-01T00:00:00Z", "session_id": i % 3, "query": f"{f}{i}", "error": "x" * 50}
    _write(tmp_path, {f"queries-{f}.jsonl": [row(f, i) for i in range(700)] for f in "ab"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = logs.read_query_log(spark, str(tmp_path), placed=True)
        assert read.rdd.getNumPartitions() > 8
        found = sessions.sessionize(read.withColumnRenamed("timestamp", "ts"), *logs.PLACE).orderBy("session_id", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["query"] for r in found] == [f"{f}{i}" for s in range(3) for f in "ab" for i in range(700) if i % 3 == s]


def test_lines_that_are_too_long_fail_when_asked_to(spark, tmp_path):
    _write(tmp_path, {"a.jsonl": [{"session_id": 1, "query": "q"}, "{broken", {"session_id": 2, "query": "x" * 3000}]})
    assert sorted(r["session_id"] for r in logs.read_query_log(spark, str(tmp_path)).collect()) == [1, 2]
    assert logs.read_query_log(spark, str(tmp_path), longest=4000).orderBy("session_id").collect() == logs.read_query_log(spark, str(tmp_path)).orderBy("session_id").collect()
    with pytest.raises(Exception, match="more than 2000 bytes in a.jsonl"):
        logs.read_query_log(spark, str(tmp_path), longest=2000).collect()


def test_retention_reads_no_old_day(spark, tmp_path):
    rows = spark.range(30).select(F.col("id"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("date"))
    rows.write.partitionBy("date").json(str(tmp_path / "log"))
    for day in range(1, 20):
        for f in (tmp_path / "log" / f"date=2024-01-{day:02d}").glob("part-*"):
            f.write_text("x" * 100 + "\n")  # would be a malformed line
    log = spark.read.schema("id long, date date").option("mode", "FAILFAST").json(str(tmp_path / "log"))
    assert sorted(r["id"] for r in logs.retain_log(log, 7).collect()) == list(range(23, 30))


def test_a_stream_of_files_goes_on_where_it_was(spark, tmp_path):
    """A second run takes only new files; files taken before may be archived."""
    folder, check, out = (str(tmp_path / n) for n in ("log", "check", "out"))
    (tmp_path / "log").mkdir()

    def run():
        stream = logs.stream_query_log(spark, folder, after="archive", archive=str(tmp_path / "old"))
        stream.select("query").writeStream.option("checkpointLocation", check).trigger(availableNow=True).format("json").start(out).awaitTermination()
        return sorted(r["query"] for r in spark.read.schema("query string").json(out).collect())

    _write(tmp_path / "log", {"a.jsonl": [{"query": "a1"}, {"query": "a2"}]})
    assert run() == ["a1", "a2"]
    _write(tmp_path / "log", {"b.jsonl": [{"query": "b1"}], "c.jsonl": [{"query": "c1"}]})
    assert run() == ["a1", "a2", "b1", "c1"]
    assert run() == ["a1", "a2", "b1", "c1"]
