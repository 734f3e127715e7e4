"""Replay of recorded reads against two sets of Spark tables."""

from __future__ import annotations

import re
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltraffic.scratch import scratch_dir

from .compare import CompareOptions, difference_counts, long_differences, redacted
from .numbering import numbered_ranges, numbered_within

_ROWS = "at long, tie long, cells array<string>, pair int, side string"
_META = "pair int, query string, original_columns array<string>, replay_columns array<string>, original_affected long, replay_affected long, original_error string, replay_error string"


@dataclass(frozen=True)
class Run:
    """What came of one query on one side: its columns, and the folder of its rows or its error."""

    columns: list[str]
    path: str | None
    error: str


def _condition(e: Exception) -> str:
    if isinstance(e, KeyError):  # a {table} that this side has not
        return "TABLE_OR_VIEW_NOT_FOUND"
    found = e.getCondition() if isinstance(e, PySparkException) else None
    named = [c for c in re.findall(r"\[([A-Z_][A-Z0-9_.]+)\]", str(e)) if c != "TASK_WRITE_FAILED"]
    return named[0] if named and found in (None, "TASK_WRITE_FAILED") else found or "UNKNOWN"


def ordered(df: DataFrame) -> tuple[DataFrame, int]:
    """A read with the values of its ORDER BY as last columns, and how many these are (0 without one, or with one of a subquery alone).

    Rows that the ORDER BY leaves in any order are put in that of their other columns, so that a rerun, and a LIMIT, give the same rows.
    The values are those of the plan, since a read need not return what it orders by.
    """
    spark, above, node = df.sparkSession, [], df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "GlobalLimit", "LocalLimit", "Offset", "WithCTE"):
        above.append(node)
        node = node.children().last()
    if node.nodeName() != "Sort" or not getattr(node, "global")():
        return df, 0
    jvm = spark._jvm
    e, seq = jvm.org.apache.spark.sql.catalyst.expressions, jvm.PythonUtils.toSeq
    listed = lambda found: [found.apply(i) for i in range(found.size())]
    order, columns = listed(node.order()), listed(node.child().output())
    by = lambda o, c: e.SortOrder(c, o.direction(), o.nullOrdering(), seq([]))
    keys = [e.Alias(o.child(), f"_t{i}", e.NamedExpression.newExprId(), seq([]), jvm.scala.Option.empty(), seq([])) for i, o in enumerate(order)]
    values = [k.toAttribute() for k in keys]
    project = jvm.org.apache.spark.sql.catalyst.plans.logical.Project
    others = [by(order[0], c) for c in columns if e.RowOrdering.isOrderable(c.dataType())]
    plan = node.copy(seq([*[by(o, v) for o, v in zip(order, values, strict=True)], *others]), True, project(seq([*columns, *keys]), node.child()), node.hint())
    for n in reversed(above):
        plan = project(seq([*listed(n.projectList()), *values]), plan) if n.nodeName() == "Project" else n.withNewChildren(seq([*listed(n.children())[:-1], plan]))
    out = DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
    return out, len(keys)


def run_isolated(spark: SparkSession, query: str, tables: dict[str, DataFrame], path: str, timeout: float | None = None) -> Run:
    """Runs one read as a job of its own, and writes its rows in their order as text, with `tie`, the same for rows that its ORDER BY leaves in any order
    (null without an ORDER BY). Whatever fails becomes its error.

    A read that cannot be analysed, or fails while it runs, gives `ERROR` and the name of Spark's error; one that takes longer than
    `timeout` seconds is cancelled and gives an `i/o timeout`, as a lost connection does.
    """
    try:
        df = spark.sql(query, **tables) if tables else spark.sql(query)
        names = df.columns
        df, n = ordered(df)
        cells = df.toDF(*[f"c{i}" for i in range(len(names) + n)])
        text = lambda c, kind: F.decode(c, "utf-8") if kind == "binary" else F.col(c).cast("string")
        tie = F.xxhash64(*[x for c in cells.columns[len(names) :] for x in (F.col(c), F.col(c).isNull())]) if n else F.lit(None).cast("long")
        shown = F.array(*[F.coalesce(text(c, kind), F.lit("NULL")) for c, kind in cells.dtypes[: len(names)]]).cast("array<string>")
        cells = cells.select(F.monotonically_increasing_id().alias("at"), tie.alias("tie"), shown.alias("cells"))
    except (PySparkException, KeyError) as e:
        return Run([], None, f"ERROR {_condition(e)}")
    sc, tag, late = spark.sparkContext, f"replay-{uuid.uuid4().hex}", threading.Event()
    clock = threading.Timer(timeout, lambda: (late.set(), sc.cancelJobsWithTag(tag))) if timeout else None
    sc.addJobTag(tag)
    try:
        if clock:
            clock.start()
        cells.write.option("compression", "zstd").parquet(path)
    except (PySparkException, Py4JError) as e:
        return Run([], None, f"i/o timeout: the query took more than {timeout:g} s" if late.is_set() else f"ERROR {_condition(e)}")
    finally:
        if clock:
            clock.cancel()
        sc.removeJobTag(tag)
    return Run(names, path, "")


#: Equal rows that are counted out at a time.
CHUNK = 10_000


def _met(loose: DataFrame) -> DataFrame:
    """Unequal rows (pair, tie, row, original, replay) of which both sides are in any order among those of a tie: equal ones meet, in whichever place, and
    are gone; the others, which are as many on both sides, meet in order of their cells, at the tie's first places. Columns that have the same values on both
    sides of a tie come first in that order, so that a row which changed in the others meets itself."""
    each = lambda side, n: loose.select("pair", "tie", F.col(side).alias("cells"), F.lit(n).alias("n"))
    left = each("original", 1).unionByName(each("replay", -1)).groupBy("pair", "tie", "cells").agg(F.sum("n").alias("n")).where("n != 0")
    moved = left.select("pair", "tie", "n", F.posexplode("cells").alias("p", "value")).groupBy("pair", "tie", "p").agg(F.sum(F.col("n") * F.pmod(F.xxhash64("value"), F.lit(1 << 31))).alias("sum"))
    moved = moved.where("sum != 0").groupBy("pair", "tie").agg(F.collect_set("p").alias("moved"))
    left, n = left.join(moved, ["pair", "tie"], "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<int>"))), F.abs("n")
    of = lambda moved: F.filter("cells", lambda _, i: F.array_contains("moved", i) == moved)
    left = left.withColumn("by", F.concat(of(False), of(True))).withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(CHUNK).cast("long"))))
    left = left.select("pair", "tie", F.when(F.col("n") > 0, 1).otherwise(2).alias("kind"), F.explode(F.sequence("low", F.least(F.col("low") + CHUNK, n) - 1)).alias("row"), "by", "cells")
    places = loose.select("pair", "tie", F.lit(0).alias("kind"), "row", *[F.lit(None).cast("array<string>").alias(c) for c in ("by", "cells")])
    dealt = numbered_within(places.unionByName(left).withColumn("of", F.struct("pair", "tie", "kind")), "of", [F.col("by"), F.col("row")], "j")
    at, original, replay = [dealt.where(F.col("kind") == k).select("pair", "tie", "j", c.alias(name)) for k, c, name in ((0, F.col("row"), "row"), (1, F.col("cells"), "original"), (2, F.col("cells"), "replay"))]
    return at.join(original, ["pair", "tie", "j"]).join(replay, ["pair", "tie", "j"]).select("pair", "row", "original", "replay")


def _unequal(rows: DataFrame, names: DataFrame, skip: Column) -> DataFrame:
    """The rows (pair, row, original, replay) of results that differ in a cell that counts; cells that do not are empty. `names` has the pairs that can be compared by cell."""
    spark = rows.sparkSession
    counts = F.transform("cells", lambda c, i: F.when(F.coalesce(F.array_contains(skip, F.get("names", i)), F.lit(False)), "").otherwise(c))
    placed = numbered_ranges(rows, ["pair", "side"], "row").join(names, "pair").select("pair", "side", "row", "tie", counts.alias("cells"))
    side = lambda name, tie: placed.where(F.col("side") == name).select("pair", "row", F.col("tie").alias(tie), F.col("cells").alias(name))
    both = side("original", "tie").join(side("replay", "_tie"), ["pair", "row"]).where("original != replay")
    both = both.select("pair", "row", "tie", F.coalesce(F.col("tie") == F.col("_tie"), F.lit(False)).alias("loose"), "original", "replay")
    path = scratch_dir(spark, "unequal")
    both.write.option("compression", "zstd").parquet(path)
    both = spark.read.schema(both.schema).parquet(path)
    return both.where("not loose").select("pair", "row", "original", "replay").unionByName(_met(both.where("loose")))


def replay_compare(
    spark: SparkSession, queries: list[str], primary: dict[str, DataFrame], replay: dict[str, DataFrame], options: CompareOptions = CompareOptions(), timeout: float | None = None, at_once: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Runs each distinct read against both sets of tables (named in it as {table}) and compares the results by position.

    Rows that a read's ORDER BY leaves in any order, and that are at the same places on both sides, are compared as such: equal ones meet.
    Gives the outcomes (query, original_error, replay_error, match, n, n_rows, types), a row per read, and all differences (query, type, row,
    position, column, original, replay). Each read and side is a job of its own, `at_once` of them at the same time; results are tables, so
    their size is that of any table.
    """
    folder = scratch_dir(spark, "replay")
    distinct = list(dict.fromkeys(queries))
    sides = {"original": primary, "replay": replay}
    jobs = [(i, q, side) for i, q in enumerate(distinct) for side in sides]
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        runs = list(pool.map(lambda job: run_isolated(spark, job[1], sides[job[2]], f"{folder}/pair={job[0]}/side={job[2]}", timeout), jobs))
    of = {(i, side): run for (i, _, side), run in zip(jobs, runs, strict=True)}
    meta = spark.createDataFrame([(i, q, of[i, "original"].columns, of[i, "replay"].columns, 0, 0, of[i, "original"].error, of[i, "replay"].error) for i, q in enumerate(distinct)], _META)
    paths = [run.path for run in runs if run.path]
    rows = spark.read.schema(_ROWS).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], _ROWS)
    counts = rows.groupBy("pair").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in sides])
    meta = meta.join(F.broadcast(counts), "pair", "left")  # a row a read
    # Results of unequal shapes are told by these alone.
    alike = meta.where((F.col("n_original") == F.col("n_replay")) & (F.size("original_columns") == F.size("replay_columns")))
    names = F.broadcast(alike.select("pair", F.col("original_columns").alias("names")))
    unequal = _unequal(rows, names, F.array(*[F.lit(c) for c in options.ignore_columns]).cast("array<string>")).join(names, "pair")
    cells = lambda side: unequal.select("pair", "row", "names", F.posexplode(side).alias("position", "value")).withColumn("column", F.get("names", F.col("position")))
    found = long_differences(meta, cells("original"), cells("replay"), "pair", options.ignore_columns)
    if options.redact_columns or options.redact_all:
        d = redacted(F.struct("type", "row", "column", "original", "replay"), options.redact_columns, options.redact_all)
        found = found.withColumn("_d", d).withColumns({c: F.col("_d")[c] for c in ("original", "replay")}).drop("_d")
    asked = F.broadcast(meta.select("pair", "query", "original_error", "replay_error"))
    outcomes = difference_counts(meta, found, "pair").join(asked, "pair").select("query", "original_error", "replay_error", "match", "n", "n_rows", "types")
    return outcomes, found.join(asked.select("pair", "query"), "pair").select("query", "type", "row", "position", "column", "original", "replay")
