import pytest
from pyspark.sql import functions as F

from sqltraffic.operators import compare, gates, metrics, sessions, stats
from sqltraffic.operators.compare import CompareOptions

SCHEMA = (
    "id int, original_columns array<string>, replay_columns array<string>, original_rows array<array<string>>, replay_rows array<array<string>>,"
    "original_affected long, replay_affected long, original_error string, replay_error string, original_ms double, replay_ms double, query string, user string"
)
NAMES = ["id", "name"]


def _pair(i, a=NAMES, b=NAMES, x=(("1", "alice"),), y=(("1", "alice"),), n=0, m=0, e="", f="", s=1.0, t=1.0, q="SELECT 1", u="u"):
    return (i, list(a), list(b), [list(r) for r in x], [list(r) for r in y], n, m, e, f, s, t, q, u)


CASES = [
    (_pair(1), []),
    (_pair(2, e="ERROR 1", f=""), ["error"]),
    (_pair(3, e="ERROR 1", f="ERROR 1", n=1), []),
    (_pair(4, n=1, m=2, y=()), ["affected_rows", "row_count"]),
    (_pair(5, b=["id"], n=1, m=2), ["affected_rows", "column_count"]),
    (_pair(6, b=["id", "title"], y=(("1", "bob"),)), ["column_name", "cell_value"]),
    (_pair(7, y=(("1", "alice"), ("2", "bob"))), ["row_count"]),
    (_pair(8, y=(("1", "bob"),)), ["cell_value"]),
]


def _results(spark, pairs, **options):
    found = compare.compare_results(spark.createDataFrame(pairs, SCHEMA), CompareOptions(**options))
    return {r["id"]: r for r in found.collect()}


def test_differences_in_order(spark):
    found = _results(spark, [c for c, _ in CASES])
    assert {i: [d["type"] for d in r["differences"]] for i, r in found.items()} == {c[0]: d for c, d in CASES}
    assert all(r["match"] == (not r["differences"]) for r in found.values())
    cell = found[8]["differences"][0]
    assert (cell["row"], cell["column"], cell["original"], cell["replay"]) == (0, "name", "alice", "bob")


def test_ignored_columns_and_redaction(spark):
    assert _results(spark, [_pair(1, y=(("1", "bob"),))], ignore_columns=["name"])[1]["match"]
    pairs = [_pair(1, y=(("2", "bob"),)), _pair(2, e="secret")]
    some = _results(spark, pairs, redact_columns=["name"])
    assert [d["replay"] for d in some[1]["differences"]] == ["2", "<redacted>"] and some[2]["differences"][0]["original"] == "secret"
    every = _results(spark, pairs, redact_all=True)
    assert every[2]["differences"][0]["original"] == "<redacted>" and every[1]["differences"][0]["original"] == "<redacted>"


def test_slow_and_ignored(spark):
    found = _results(spark, [_pair(1, s=10.0, t=200.0), _pair(2, y=(("2", "x"),), q="select now()")], time_threshold_ms=50.0, ignore_queries=["NOW\\(\\)"])
    assert found[1]["time_diff_exceeded"] and found[1]["match"] and not found[2]["time_diff_exceeded"] and found[2]["ignored"]


def test_bad_pattern(spark):
    with pytest.raises(Exception):
        _results(spark, [_pair(1)], ignore_queries=["("])


def test_summary_of_one_to_hundred(spark):
    rows = spark.range(1, 101).select(
        F.lit("d").alias("digest"), F.lit("q").alias("query"), F.lit(True).alias("match"), F.array().cast("array<struct<type:string>>").alias("differences"),
        F.col("id").cast("double").alias("original_time_ms"), F.col("id").cast("double").alias("replay_time_ms"), F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("session_id"), F.col("id").alias("seq"),
    )
    r = stats.digest_summary(rows).first()
    assert (r["original_avg_ms"], r["original_p95_ms"], r["original_p99_ms"], r["overhead_p99_ms"]) == (50.5, 95.0, 99.0, 0.0)


def test_cap_and_reservoir(spark):
    rows = spark.createDataFrame([(f"d{i % 5}", i) for i in range(50)], "digest string, seq long").withColumns({"ts": F.timestamp_seconds("seq"), "session_id": F.lit(1)})
    capped = stats.digest_cap(rows, 3)
    assert sorted(r["digest"] for r in capped.where("admitted").collect()) == ["d0", "d1", "d2"]
    assert stats.cap_overflow(capped).first()["overflow"] == 20
    assert stats.reservoir_sample(rows, 4).count() == 20


def test_temp_table_gate(spark):
    steps = [
        ("CREATE TEMPORARY TABLE scratch (x INT)", True), ("INSERT INTO scratch VALUES (1)", True), ("UPDATE `scratch` SET x = 1", True), ("INSERT INTO real_users VALUES (1)", False),
        ("DELETE FROM SCRATCH", True), ("TRUNCATE mydb.scratch", True), ("INSERT INTO scratch VALUES (2)", True), ("UPDATE scratch JOIN t ON 1 SET x = 1", False),
        ("DROP TEMPORARY TABLE scratch", True), ("INSERT INTO scratch VALUES (1)", False), ("CREATE TEMPORARY TABLE IF NOT EXISTS s2 (x INT)", True), ("DROP TABLE s2", True), ("DROP TABLE s2", False),
    ]
    log = spark.createDataFrame([(7, i, q) for i, (q, _) in enumerate(steps)], "session_id long, seq long, query string")
    assert [r["passes"] for r in sessions.temp_table_gate(log).orderBy("seq").collect()] == [p for _, p in steps]


def test_gates(spark):
    log = spark.createDataFrame([("10.0.5.1:9",), ("10.1.0.1:9",), ("11.0.0.1:9",), ("",)], "source_ip string")
    kept = gates.gate_by_cidr(log, ["10.0.0.0/8"], ["10.0.5.0/24"])
    assert sorted(r[0] for r in kept.collect()) == ["", "10.1.0.1:9"]
    with pytest.raises(ValueError):
        gates.gate_by_sample(log, 1.5)
    many = spark.range(4000)
    assert gates.gate_by_sample(many, 0, F.col("id")).count() == 0 and gates.gate_by_sample(many, 1, F.col("id")).count() == 4000
    assert abs(gates.gate_by_sample(many, 0.5, F.col("id")).count() - 2000) < 200


def test_heartbeats_of_idle_intervals(spark):
    rows = spark.createDataFrame([(0, True, False), (1, False, False), (125, False, True)], "s long, match boolean, ignored boolean").withColumn("ts", F.timestamp_seconds("s"))
    beats = metrics.heartbeats(rows, 60).orderBy("timestamp").collect()
    assert [(b["window_total"], b["window_differed"], b["window_ignored"], b["cumulative_total"]) for b in beats] == [(2, 1, 0, 2), (0, 0, 0, 2), (1, 0, 1, 3)]


NULLS = [
    (_pair(1)[:7] + (None, "ERROR 1146", 1.0, 1.0, "q", "u"), ["error"]),
    (_pair(2)[:7] + (None, "", 1.0, 1.0, "q", "u"), []),
    (_pair(3)[:5] + (None, 3) + _pair(3)[7:], ["affected_rows"]),
    (_pair(4)[:5] + (None, 0) + _pair(4)[7:], []),
    (_pair(5, x=((None, "alice"),)), ["cell_value"]),
    (_pair(6, x=((None, "alice"),), y=(("NULL", "alice"),)), []),
    (_pair(7, y=(("1", None),)), ["cell_value"]),
    (_pair(8, a=["id", None]), ["column_name"]),
    (_pair(9, a=["id", None], b=["id", ""]), []),
    (_pair(10)[:1] + (None,) + _pair(10)[2:], ["column_count"]),
    (_pair(11)[:3] + (None,) + _pair(11)[4:], ["row_count"]),
    (_pair(12, y=(("1",),)), ["cell_value"]),
    (_pair(13)[:4] + ([None],) + _pair(13)[5:], ["cell_value", "cell_value"]),
]


def _long(spark, pairs, **more):
    df = spark.createDataFrame(pairs, SCHEMA)
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<array<string>>")))
    meta = df.withColumns({"n_original": size(F.col("original_rows")), "n_replay": size(F.col("replay_rows"))}).drop("original_rows", "replay_rows")
    return meta, compare.long_differences(meta, compare.cells_of(df, "id", "original"), compare.cells_of(df, "id", "replay"), "id", **more)


def test_nulls_are_their_stand_ins(spark):
    found = _results(spark, [p for p, _ in NULLS])
    assert {i: [d["type"] for d in r["differences"]] for i, r in found.items()} == {p[0]: t for p, t in NULLS}
    assert found[1]["differences"][0]["original"] == "" and found[3]["differences"][0]["original"] == "0" and found[5]["differences"][0]["original"] == "NULL"
    assert found[8]["differences"][0]["original"] == "" and found[12]["differences"][0]["replay"] == "NULL"


def test_long_form_agrees_with_nested(spark):
    pairs = [p for p, _ in NULLS] + [(p[0] + 100, *p[1:]) for p, _ in CASES]
    nested = {i: [(d["type"], d["row"], d["column"], d["original"], d["replay"]) for d in r["differences"]] for i, r in _results(spark, pairs).items()}
    meta, found = _long(spark, pairs)
    pages = compare.difference_pages(found, "id", rows=1).orderBy("id", "page").collect()
    in_pages = {i: [tuple(d) for r in pages if r["id"] == i for d in r["differences"]] for i in nested}
    assert in_pages == nested
    counts = {r["id"]: r for r in compare.difference_counts(meta, found, "id").collect()}
    assert {i: (r["match"], r["n"], list(r["types"])) for i, r in counts.items()} == {i: (not d, len(d), sorted({x[0] for x in d})) for i, d in nested.items()}


def test_nulls_in_offline_comparison(spark):
    log = spark.createDataFrame([(1, 1, "q", None, None, 5), (1, 2, "q", "", 0, None)], "session_id int, seq int, query string, original_error string, original_affected long, rows_returned long")
    other = spark.createDataFrame([(1, 1, "", 0, ["a"], [["x"]]), (1, 2, None, 3, None, None)], "session_id int, seq int, replay_error string, replay_affected long, replay_columns array<string>, replay_rows array<array<string>>")
    found = {r["seq"]: [d["type"] for d in r["differences"]] for r in compare.offline_compare(log, other, compare_rows_returned=True).collect()}
    assert found == {1: ["row_count"], 2: ["affected_rows"]}


def test_a_pair_of_very_many_differences(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("row"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    cells = rows.select("id", "row", "position", F.element_at(F.array(F.lit("a"), F.lit("b")), F.col("position") + 1).alias("column"), F.concat("row", F.lit("x")).alias("value"))
    other = cells.withColumn("value", F.when(F.col("position") == 1, F.lit(None).cast("string")).otherwise(F.concat("row", F.lit("y"))))
    meta = spark.createDataFrame([(1, ["a", "b"], ["a", "b"], 0, 0, "", "", n, n)], "id int, original_columns array<string>, replay_columns array<string>, original_affected long, replay_affected long, original_error string, replay_error string, n_original int, n_replay int")
    found = compare.long_differences(meta, cells, other, "id")
    assert found.count() == 2 * n
    sizes = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * n
    pages = compare.difference_pages(found, "id", rows=500)
    assert pages.agg(F.max("n"), F.count("*"), F.sum("n")).first()[:] == (1000, n // 500, 2 * n)
    first = compare.first_differences(found, "id", 5).orderBy("rank").collect()
    assert [(r["row"], r["column"]) for r in first] == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "a")]


def test_patterns_are_those_that_will_run(spark):
    rows = spark.createDataFrame([("select NOW()",), ("select 1",)], "query string")
    assert [r["ignored"] for r in gates.mark_ignored(rows, ["\\p{Alpha}+\\(\\)"]).collect()] == [True, False]
    for bad in ("(?P<x>a)", "("):
        with pytest.raises(ValueError, match="regular expression"):
            gates.mark_ignored(rows, [bad])


def test_timeouts_tear_sessions_down(spark):
    rows = [(1, 1, "", 5.0), (1, 2, "", 90.0), (1, 3, "", 5.0), (2, 1, "", None), (2, 2, "i/o timeout", 5.0), (2, 3, "", 1.0), (3, 1, "ERROR 1064 (42000)", 5.0), (3, 2, "", 50.0)]
    df = spark.createDataFrame(rows, "session_id int, seq int, error string, replay_ms double")
    dropped = lambda **more: {(r["session_id"], r["seq"]) for r in sessions.teardown_effect(df, **more).where("dropped").collect()}
    assert dropped() == {(2, 3)}
    assert dropped(timeout_ms=50.0) == {(1, 2), (1, 3), (2, 3)}
