"""Recorded reads run against two sets of tables, each as a job of its own."""

import pytest
from pyspark.sql import functions as F

from sqltraffic.operators.compare import CompareOptions
from sqltraffic.operators.replay import replay_compare


def _found(spark, reads, primary, other, **more):
    outcomes, differences = replay_compare(spark, reads, primary, other, **more)
    rows = differences.orderBy("query", "row", "position").collect()
    return {r["query"]: r for r in outcomes.collect()}, {q: [(r["type"], r["original"], r["replay"]) for r in rows if r["query"] == q] for q in reads}


@pytest.fixture(scope="module")
def sides(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, name string")
    other = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, name string")
    return {"t": t, "only": t}, {"t": other}


def test_two_sets_of_tables(spark, sides):
    reads = {
        "SELECT name FROM {t} WHERE id < 3 ORDER BY id": [("cell_value", "NULL", "b")],
        "SELECT id FROM {t} WHERE id < 3 ORDER BY id": [],
        "SELECT count(*) AS n FROM {t}": [("cell_value", "3", "4")],
        "SELECT id FROM {t}": [("row_count", "3", "4")],
        "SELECT id AS x FROM {t} WHERE id > 9": [],
        "SELECT name FROM {only} ORDER BY 1": [("error", "", "ERROR TABLE_OR_VIEW_NOT_FOUND")],
        "SELECT nothing FROM {t}": [],
    }
    outcomes, found = _found(spark, [*reads, *reads], *sides)
    assert found == reads
    assert {q: (r["match"], r["n"]) for q, r in outcomes.items()} == {q: (not d, len(d)) for q, d in reads.items()}
    assert outcomes["SELECT nothing FROM {t}"]["original_error"].startswith("ERROR UNRESOLVED_COLUMN")


def test_errors_while_running_stay_with_their_read(spark, sides):
    reads = {
        "SELECT 1 DIV (id - 4) AS x FROM {t} ORDER BY id": [("error", "", "ERROR DIVIDE_BY_ZERO")],
        "SELECT raise_error('no') AS x FROM {t}": [],
        "SELECT max(id) AS x FROM {t}": [("cell_value", "3", "4")],
    }
    outcomes, found = _found(spark, list(reads), *sides)
    assert found == reads
    assert outcomes["SELECT raise_error('no') AS x FROM {t}"]["replay_error"] == "ERROR USER_RAISED_EXCEPTION"


def test_slow_reads_are_cancelled(spark, sides):
    slow, quick = "SELECT sum(sqrt(a.id * b.id)) AS x FROM range(3000000) a, range(3000000) b, {t}", "SELECT count(*) AS n FROM {t}"
    outcomes, found = _found(spark, [slow, quick], *sides, timeout=15.0, at_once=1)
    assert outcomes[slow]["original_error"].startswith("i/o timeout") and outcomes[slow]["match"]
    assert found[quick] == [("cell_value", "3", "4")]


def test_large_results_meet_by_position(spark):
    left = spark.range(200_000).select("id", (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") % 2 == 0, F.col("v")).otherwise(-F.col("v") - 1))
    read = "SELECT id, v FROM {t} ORDER BY id DESC"
    outcomes, differences = replay_compare(spark, [read], {"t": left}, {"t": right}, CompareOptions(redact_columns=["v"]))
    assert outcomes.first()["n"] == outcomes.first()["n_rows"] == 100_000
    assert differences.agg(F.min("row"), F.max("row"), F.count_distinct("row")).first()[:] == (0, 199_998, 100_000)
    assert {r[0] for r in differences.select("original").distinct().collect()} == {"<redacted>"}


def test_rows_that_an_order_leaves_open_meet_their_equals(spark):
    """Both sides have the same rows but for those that were changed, in other places; k has ties, z is one tie, and v repeats."""
    left = spark.range(6_000).select("id", (F.col("id") % 700).alias("k"), (F.col("id") % 900).alias("v"), F.lit(0).alias("z"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("m"))
    changed = F.col("id") % 50 == 0
    right = left.withColumn("v", F.when(changed, -1).otherwise(F.col("v"))).orderBy(F.md5(F.col("id").cast("string"))).repartition(5)
    reads = {
        "SELECT k, v FROM {t} ORDER BY k": 120,
        "SELECT v FROM {t} ORDER BY k DESC, z": 120,
        "SELECT v AS x, z FROM {t} ORDER BY z": 120,
        "SELECT v, id FROM {t} ORDER BY m NULLS LAST": 120,
        "WITH x AS (SELECT k, v FROM {t} WHERE k < 350) SELECT v FROM x ORDER BY k % 5": 63,
        "(SELECT k, v FROM {t}) UNION ALL (SELECT k, v FROM {t}) ORDER BY k": 240,
        "SELECT k, id FROM {t} ORDER BY z LIMIT 500 OFFSET 100": 0,
        "SELECT k, count(*) AS n FROM {t} GROUP BY k ORDER BY max(z)": 0,
        "SELECT k, v FROM {t} ORDER BY id": 120,
    }
    outcomes, differences = replay_compare(spark, list(reads), {"t": left}, {"t": right})
    assert {r["query"]: (r["n"], r["n_rows"]) for r in outcomes.collect()} == {q: (n, n) for q, n in reads.items()}
    assert differences.where("column in ('v', 'x') and replay = '-1' and original != '-1'").count() == differences.count()
    # A column that does not count has no part in who meets whom.
    read = "SELECT id, v, k FROM {t} ORDER BY z"
    outcomes, _ = replay_compare(spark, [read], {"t": left}, {"t": right.withColumn("id", F.col("id") + 1)}, CompareOptions(ignore_columns=["id"]))
    assert outcomes.first()["n"] == 120


def test_rows_of_other_ties_are_not_taken_for_each_other(spark):
    """The values of two ties are exchanged; hidden, null and several keys tell ties apart."""
    left = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (None, 1, "c"), (None, 1, "d"), (2, 2, "e")], "i int, j int, v string")
    right = left.withColumn("v", F.translate("v", "abcd", "cdba"))
    reads = {"SELECT v FROM {t} ORDER BY i, j": 4, "SELECT v FROM {t} ORDER BY j, i": 4, "SELECT v FROM {t} ORDER BY i > 1 NULLS FIRST, i < 0": 4, "SELECT v FROM {t} ORDER BY i IS NULL AND i IS NOT NULL": 0}
    outcomes, _ = replay_compare(spark, list(reads), {"t": left}, {"t": right})
    assert {r["query"]: r["n"] for r in outcomes.collect()} == reads
