"""A stream to its very end."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sqltraffic.plans import fixtures, queries

SF = "/root/testdata/sf0.001"


def write_events(spark, path, events):
    """Statements of two sessions: numbers and seconds."""
    rows = spark.createDataFrame([(i, s, 1 + k % 2) for k, (i, s) in enumerate(events)], "event_id long, s long, user_id long")
    rows.select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.5).alias("value")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return spark.read.parquet(f"{path}/events.parquet").count()


def by_sql(path, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return sorted(map(str, con.execute(f"SELECT session_id, seq, replay_ms FROM ({queries.oracle_sql()[name]})").fetchall()))


def given(spark, path, name):
    return sorted(str(tuple(r)) for r in queries.queries()[name](spark, str(path)).select("session_id", "seq", "replay_ms").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
def test_stream_pair_gives_all_rows(spark):
    pairs = fixtures.result_pairs(spark, SF)
    all_rows = pairs.select("session_id", "seq", F.when(F.col("event_id") % 19 != 0, F.col("replay_ms")).alias("replay_ms"))
    got = sorted(map(str, queries.stream_paired(spark, SF).select(*all_rows.columns).collect()))
    assert got == sorted(map(str, all_rows.collect()))


@pytest.mark.parametrize(
    "events",
    [[(1, 0), (2, 3600), (19, 3660), (38, 3661), (3, 3700)], [(1, 0), (2, 60), (19, 61), (38, 3 * 86_400)], [(19, 0), (38, 60)], [(1, 0)], []],
    ids=["last minutes", "last days have no replies", "no replies", "one statement", "empty"],
)
def test_statements_of_the_end_without_a_reply_come_out(spark, tmp_path, events):
    """Statements whose number is a multiple of 19 have no reply: alone, they wait for the watermark."""
    assert write_events(spark, tmp_path, events) == len(events)
    assert given(spark, tmp_path, "x5_stream_pair") == by_sql(tmp_path, "x5_stream_pair")


@pytest.mark.parametrize("events", [[(1, 0), (2, 3600), (19, 3660), (38, 3661), (3, 3700)], [(19, 0), (38, 60), (76, 61)]], ids=["last minutes", "no replies"])
def test_gated_statements_of_the_end_without_a_reply_come_out(spark, tmp_path, events):
    assert write_events(spark, tmp_path, events) == len(events)
    found = by_sql(tmp_path, "x12_stream_replayed")
    assert any("None" in r for r in found)
    assert given(spark, tmp_path, "x12_stream_replayed") == found
