"""Percentiles, caps and samples that are worked out in parts, against plain ones."""

import math
import random

from pyspark.sql import functions as F

from sqltraffic.operators import stats


def test_nearest_ranks(spark):
    random.seed(5)
    draw = [lambda: random.gauss(0, 50), lambda: float(random.randrange(4)), lambda: random.paretovariate(0.3), lambda: 2.0 ** random.randrange(-60, 60), lambda: -(3.0**-30) * random.random()]
    rows = [(None if g == 4 else f"g{g}", draw[g](), random.choice([None, 7.0, 8.0, 1e300])) for g in range(5) for _ in range(random.choice([1, 20, 700]))]
    rows += [("none", None, None), ("one", 3.0, None), ("edge", math.inf, -math.inf), ("edge", -math.inf, 0.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    found = {r["k"]: r.asDict() for r in stats.nearest_ranks(df, ["k"], ["a", "b"], points).collect()}
    for k in {r[0] for r in rows}:
        for i, c in enumerate("ab", 1):
            values = sorted(r[i] for r in rows if r[0] == k and r[i] is not None)
            for n, p in points.items():
                want = values[math.ceil(p * len(values)) - 1] if values else None
                assert found.get(k, {}).get(f"{c}_{n}") == want, (k, c, n)


def test_nearest_ranks_of_nothing(spark):
    assert stats.nearest_ranks(spark.createDataFrame([], "k string, a double"), ["k"], ["a"], {"p50": 0.5}).collect() == []


def test_digest_cap_ranks_over_hours(spark):
    rows = [(f"d{i % 40}" if i % 41 else None, i * 97 % 500, i) for i in range(400)]
    df = spark.createDataFrame(rows, "digest string, minute int, seq int").select("digest", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, minute)").alias("ts"), F.lit(1).alias("session_id"), "seq")
    first = {}
    for d, minute, seq in rows:
        first[d] = min(first.get(d, (10**9, 0)), (minute, seq))
    order = sorted(first, key=lambda d: first[d])
    assert {(r["digest"], r["rank"], r["admitted"]) for r in stats.digest_cap(df, 7).collect()} == {(d, i, i <= 7) for i, d in enumerate(order, 1)}


def test_reservoir_sample_is_whole_or_k(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4990, "hot").otherwise("rare").alias("digest"), (F.col("id") % 50).alias("session_id"), F.col("id").alias("seq"))
    drawn = stats.reservoir_sample(df, 1200, seed=3)
    assert {r["digest"]: r["n"] for r in drawn.groupBy("digest").agg(F.count_distinct("seq").alias("n")).collect()} == {"hot": 1200, "rare": 10}
    mean = drawn.where("digest = 'hot'").agg(F.avg("seq")).first()[0]
    assert abs(mean - 2495) < 5 * 1441 / math.sqrt(1200)
    assert drawn.exceptAll(stats.reservoir_sample(df.repartition(7), 1200, seed=3)).count() == 0
