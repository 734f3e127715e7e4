"""Streams into tables: beats, sketches, samples and reports, against their batch forms."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sqltraffic.operators import metrics, sketches, stats
from sqltraffic.plans.queries import LATE, drained, in_batches, oracle_sql, queries
from sqltraffic.streaming import kept, stateful

ROW = "ts timestamp, digest string, session_id long, seq long, ignored boolean, match boolean, original_time_ms double, replay_time_ms double"


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(4)
    rows = [(sum(rng.choice([1, 2, 90, 700]) for _ in range(i % 40)) + 3000 * (i % 7), rng.choice("abb"), i % 9, i, rng.random() < 0.1, rng.random() < 0.6, rng.expovariate(0.1), None if i % 50 == 0 else rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "s long, digest string, session_id long, seq long, ignored boolean, match boolean, original_time_ms double, replay_time_ms double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").withColumn("differences", F.array().cast("array<struct<type:string>>"))


def test_streamed_beats_are_those_of_the_table(spark, results):
    rows = results.select("ts", "ignored", "match")
    stream, checkpoint = in_batches(spark, rows, "ts", files=4, close=60 + LATE)
    with stateful.timed_state(spark):
        found = drained(stateful.stream_heartbeats(stream, 60), checkpoint)
    want = metrics.heartbeats(rows, 60)
    assert want.where("window_total = 0").count() > 10
    assert sorted(found.select(want.columns).collect()) == sorted(want.collect())


def test_sketches_of_parts_are_those_of_the_whole(spark, results):
    whole = sketches.sketch_summary(sketches.merged(sketches.sketch_hours(results), "digest"))
    parts = [sketches.sketch_hours(results.where(F.col("seq") % 5 == i)) for i in range(5)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    of = {r["digest"]: r for r in sketches.sketch_summary(sketches.merged(union, "digest")).collect()}
    rows = results.collect()
    for r in whole.collect():
        other = of[r["digest"]]
        assert [r[c] for c in (*sketches.COUNTS, "n_sessions")] == [other[c] for c in (*sketches.COUNTS, "n_sessions")]
        assert r["n_sessions"] == 9 and r["original_avg_ms"] == pytest.approx(other["original_avg_ms"])
        for side in sketches.SIDES:
            values = sorted(x[f"{side}_time_ms"] for x in rows if x["digest"] == r["digest"] and x[f"{side}_time_ms"] is not None)
            for p in (0.95, 0.99):
                for got in (r, other):
                    rank = sum(v <= got[f"{side}_p{round(100 * p)}_ms"] for v in values) / len(values)
                    assert abs(rank - p) < 0.02


def test_streamed_sample_is_that_of_the_table(spark, results):
    by = F.xxhash64("session_id", "seq", F.lit(3))
    rows = results.select("digest", "session_id", "seq", "ts")
    stream, checkpoint = in_batches(spark, rows, "ts", files=4)
    kept.stream_sample(stream, by, ["session_id", "seq"], 25, checkpoint, f"{checkpoint}-sample").awaitTermination()
    found = kept.read_sample(spark, f"{checkpoint}-sample")
    assert found.groupBy("digest").count().agg(F.max("count")).first()[0] == 25
    want = stats.reservoir_sample(rows, 25, seed=3)
    assert sorted(map(tuple, found.select("digest", "session_id", "seq").collect())) == sorted(map(tuple, want.select("digest", "session_id", "seq").collect()))
    folders = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-sample")
    assert len(folders.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folders)) == 2


def test_a_report_has_whole_batches_once(spark, tmp_path):
    out, schema = str(tmp_path / "report"), "id long"
    assert kept.read_report(spark, out, schema).count() == 0
    kept.commit_batch(spark.range(3), 0, out)
    failing = spark.range(10, 14).select(F.when(F.col("id") < 13, F.col("id")).otherwise(F.raise_error(F.lit("killed"))).cast("long").alias("id"))
    with pytest.raises(Exception):
        kept.commit_batch(failing.repartition(4), 1, out)
    (tmp_path / "report" / "rows" / "batch-1-dead").mkdir(parents=True)
    (tmp_path / "report" / "rows" / "batch-1-dead" / "part-0.json").write_text('{"id": 99}\n')
    assert sorted(r[0] for r in kept.read_report(spark, out, schema).collect()) == [0, 1, 2]
    for _ in range(2):
        kept.commit_batch(spark.range(10, 14), 1, out)
    assert sorted(r[0] for r in kept.read_report(spark, out, schema).collect()) == [0, 1, 2, 10, 11, 12, 13]


def test_summaries_read_their_table_once(spark, tmp_path, results):
    results.withColumn("query", F.lit("q")).write.parquet(str(tmp_path / "results"))
    read = spark.read.parquet(str(tmp_path / "results"))
    plan = stats.digest_summary(read)._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in plan and plan.count("Relation") > 0


@pytest.mark.parametrize("seconds", [[0, 60, 9_000, 9_900, 20_000, 30_000], [0, 1, 2, 4, 6], [0], []], ids=["end of the third", "short", "one row", "empty"])
def test_all_late_rows_are_counted(spark, tmp_path, seconds):
    """Those too that lie within the gate's hour before the end of the first third; a log shorter than that hour; and none."""
    rows = [(97 * i, s, 1 + i % 2) for i, s in enumerate(seconds)] + [(97 * i + 1, s, 3) for i, s in enumerate(seconds[1:])]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = con.execute(f"SELECT name, kind, value FROM ({oracle_sql()['x11_late_rows']})").fetchall()
    assert list(map(tuple, queries()["x11_late_rows"](spark, str(tmp_path)).select("name", "kind", "value").collect())) == found
