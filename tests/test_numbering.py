"""Numbers given range by range, against a sort in one place."""

import random

from pyspark.sql import functions as F

from sqltraffic.operators import compare
from sqltraffic.operators.numbering import _dealt, numbered, numbered_within


def test_numbers_follow_the_order(spark):
    random.seed(2)
    rows = [(random.choice([None, "a", "hot", "hot", "hot"]), random.randrange(400), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert {(r["i"], r["n"]) for r in numbered(df, [F.col("v"), F.col("i")], "n").collect()} == {(r[2], n) for n, r in enumerate(order)}
    found = {r["i"]: r["n"] for r in numbered_within(df, "k", [F.col("v"), F.col("i")], "n").collect()}
    for k in {r[0] for r in rows}:
        assert [found[r[2]] for r in order if r[0] == k] == list(range(sum(r[0] == k for r in rows)))
    assert numbered(df.where("false"), [F.col("v")], "n").collect() == []


def _diff(a, b, key):
    groups = {}
    for side, rows in ((0, a), (1, b)):
        for r in rows:
            groups.setdefault(r[0] if key else 0, ([], []))[side].append(r)
    out = []
    for k, (x, y) in groups.items():
        x, y = (sorted(rows, key=lambda r: (r[1], str(r[2]))) for rows in (x, y))
        for i in range(max(len(x), len(y))):
            for c, name in ((1, "o"), (2, "v")):
                left, right = ("NULL" if rows[i][c] is None else str(rows[i][c]) if i < len(rows) else None if i >= len(rows) else None for rows in (x, y)) if i < min(len(x), len(y)) else (str(rows[i][c]) if i < len(rows) and rows[i][c] is not None else "NULL" if i < len(rows) else None for rows in (x, y))
                if left != right:
                    out.append((*([k] if key else []), i, name, left, right))
    return sorted(out, key=str)


def test_tables_with_and_without_a_key(spark):
    random.seed(3)
    make = lambda n: [(random.choice([None, 1, 2, 2, 2]), random.randrange(50), random.choice([None, "x", "y"])) for _ in range(n)]
    a, b = make(400), make(430)
    left, right = (spark.createDataFrame(rows, "k int, o int, v string") for rows in (a, b))
    for key in ("k", None):
        found = compare.diff_tables(left, right, key, ["o"], ["o", "v"])
        assert sorted(map(tuple, found.collect()), key=str) == _diff(a, b, key)


def test_no_range_has_more_than_its_share(spark):
    """A hundred thousand rows of one key, half of them equal, still lie in ranges of about the same size."""
    df = spark.range(100_000).select(F.lit(1).alias("k"), F.greatest("id", F.lit(50_000)).alias("o"))
    ranges = _dealt(df, [F.col("k"), F.col("o"), F.monotonically_increasing_id()]).groupBy("range").count().agg(F.max("count"), F.sum("count")).first()
    assert ranges[1] == 100_000 and ranges[0] < 40_000
