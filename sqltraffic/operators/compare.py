"""Comparison of two sides' results, and what follows from it.

A pair is a row with `original_` and `replay_` columns: columns (array of names), rows (array of
arrays of text), affected, error, and optionally ms. Cells are compared as text, and a NULL, or a cell that a row
has not, is the text NULL. A null error is no error, null affected rows are 0, a null name is empty, and null columns or
rows are none: on both sides, so that a null on one is a difference wherever its stand-in is.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltraffic.functions import statements
from sqltraffic.operators.numbering import numbered, numbered_within
from sqltraffic.schema import DIFFERENCE

REDACTED = "<redacted>"


@dataclass(frozen=True)
class CompareOptions:
    ignore_columns: list[str] = field(default_factory=list)
    ignore_queries: list[str] = field(default_factory=list)
    time_threshold_ms: float = 0.0
    redact_columns: list[str] = field(default_factory=list)
    redact_all: bool = False


def truncated_ms(ms: Column) -> Column:
    """Milliseconds as whole microseconds, cut off."""
    return F.floor(ms * 1000.0) / 1000.0


def result_timing(pairs: DataFrame) -> DataFrame:
    original, replay = truncated_ms(F.col("original_ms")), truncated_ms(F.col("replay_ms"))
    return pairs.withColumns({"original_time_ms": original, "replay_time_ms": replay, "time_diff_ms": replay - original})


def flag_slow(results: DataFrame, threshold_ms: float) -> DataFrame:
    slow = F.abs("time_diff_ms") > threshold_ms if threshold_ms > 0 else F.lit(False)
    return results.withColumn("time_diff_exceeded", slow)


def stringify_table(df: DataFrame) -> DataFrame:
    """All columns as comparison text."""
    text = lambda c, kind: F.decode(F.col(c), "utf-8") if kind == "binary" else F.col(c).cast("string")
    return df.select(*[F.coalesce(text(c, kind), F.lit("NULL")).alias(c) for c, kind in df.dtypes])


def _difference(kind: str, row: Column, column: Column, original: Column, replay: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), row.cast("int").alias("row"), column.cast("string").alias("column"), original.cast("string").alias("original"), replay.cast("string").alias("replay"))


def _sides(what: str, default: object) -> list[Column]:
    """Both sides' values of a column, a null as its stand-in."""
    return [F.coalesce(F.col(f"{side}_{what}"), default if isinstance(default, Column) else F.lit(default)) for side in ("original", "replay")]


def _names() -> list[Column]:
    return [F.transform(names, lambda n: F.coalesce(n, F.lit(""))) for names in _sides("columns", F.array().cast("array<string>"))]


def _cell(rows: Column, r: Column, c: Column) -> Column:
    return F.coalesce(F.get(F.get(rows, r), c), F.lit("NULL"))


def _one(kind: str, left: Column, right: Column) -> Column:
    return F.array(_difference(kind, F.lit(0), F.lit(""), left, right))


def _headers(names: Column, others: Column) -> Column:
    each = F.transform(names, lambda n, i: F.when(n != F.get(others, i), _difference("column_name", F.lit(0), F.concat(F.lit("index_"), i.cast("string")), n, F.get(others, i))))
    return F.filter(each, lambda d: d.isNotNull())


def _decided(n: Column, m: Column, cells: Column) -> Column:
    """The decision procedure: each step either stops or goes on to the next. `cells` are what equal shapes of n and m rows come to."""
    nothing = F.array().cast(f"array<{DIFFERENCE}>")
    (error, other_error), (affected, other_affected), (names, others) = _sides("error", ""), _sides("affected", 0), _names()
    changed = F.when(affected != other_affected, _one("affected_rows", affected, other_affected)).otherwise(nothing)
    headers = _headers(names, others)
    body = F.when(n != m, F.concat(headers, _one("row_count", n, m))).otherwise(F.concat(headers, cells))
    shape = F.when(F.size(names) != F.size(others), _one("column_count", F.size(names), F.size(others))).otherwise(body)
    return F.when(error != other_error, _one("error", error, other_error)).when(error != "", nothing).otherwise(F.concat(changed, shape))


def _differences(ignored: list[str]) -> Column:
    (names, _), (rows, others) = _names(), _sides("rows", F.array().cast("array<array<string>>"))
    skip = F.array(*[F.lit(c) for c in ignored]).cast("array<string>")
    cells = F.flatten(F.transform(rows, lambda row, r: F.filter(
        F.transform(F.coalesce(row, F.array().cast("array<string>")), lambda _, c: F.when(
            (_cell(rows, r, c) != _cell(others, r, c)) & ~F.coalesce(F.array_contains(skip, F.get(names, c)), F.lit(False)),
            _difference("cell_value", r, F.coalesce(F.get(names, c), F.lit("")), _cell(rows, r, c), _cell(others, r, c)),
        )),
        lambda d: d.isNotNull(),
    )))
    return _decided(F.size(rows), F.size(others), cells)


def compare_results(pairs: DataFrame, options: CompareOptions = CompareOptions()) -> DataFrame:
    """Adds `differences` (array), `match` and, where there is a query, `ignored` and `user` of real mismatches."""
    from .gates import mark_ignored

    out = pairs.withColumn("differences", _differences(options.ignore_columns))
    out = out.withColumn("match", F.size("differences") == 0)
    if options.redact_columns or options.redact_all:
        out = out.withColumn("differences", F.transform("differences", lambda d: redacted(d, options.redact_columns, options.redact_all)))
    if "query" in pairs.columns:
        out = mark_ignored(out, options.ignore_queries)
    if "original_ms" in pairs.columns:
        out = flag_slow(result_timing(out), options.time_threshold_ms)
    return out


def redacted(d: Column, columns: list[str], everything: bool) -> Column:
    """A difference with its values hidden: cells of listed columns, or of all; errors only with all."""
    hide = F.lit(everything) & d["type"].isin("cell_value", "error") | (d["type"] == "cell_value") & d["column"].isin(columns)
    mask = lambda v: F.when(hide, F.lit(REDACTED)).otherwise(v)
    return F.struct(d["type"].alias("type"), d["row"].alias("row"), d["column"].alias("column"), mask(d["original"]).alias("original"), mask(d["replay"]).alias("replay"))


def attach_user(results: DataFrame) -> DataFrame:
    return results.withColumn("user", F.when(~F.col("match") & ~F.col("ignored"), F.col("user")).otherwise(""))


def emit_filter(results: DataFrame, log_matches: bool = False) -> DataFrame:
    return results if log_matches else results.where("not match and not ignored")


def pair_results(primary: DataFrame, replay: DataFrame) -> DataFrame:
    """Each primary statement with the replay of the same place in its session; those without one are left out."""
    return primary.join(replay, ["session_id", "seq"])


def exploded(results: DataFrame, *keys: str) -> DataFrame:
    return results.select(*keys, F.explode("differences").alias("d")).select(*keys, "d.*")


def diff_breakdown(results: DataFrame) -> DataFrame:
    return exploded(results).groupBy("type", "column").agg(F.count("*").alias("count"))


def column_drift(results: DataFrame) -> DataFrame:
    """Which columns' cells differ, how often, and the first row that does."""
    return exploded(results).where("type = 'cell_value'").groupBy("column").agg(F.count("*").alias("count"), F.min("row").alias("first_row"))


def schema_diff(pairs: DataFrame, key: str) -> DataFrame:
    """Differences of the results' columns alone."""
    names, others = _names()
    size = pairs.where(F.size(names) != F.size(others)).select(key, F.lit("column_count").alias("type"), F.lit("").alias("column"), F.size(names).cast("string").alias("original"), F.size(others).cast("string").alias("replay"))
    each = pairs.where(F.size(names) == F.size(others)).select(key, F.posexplode(F.arrays_zip(names.alias("original"), others.alias("replay"))).alias("i", "x"))
    named = each.where("x.original != x.replay").select(key, F.lit("column_name").alias("type"), F.concat(F.lit("index_"), F.col("i").cast("string")).alias("column"), "x.original", "x.replay")
    return size.unionByName(named)


def diff_tables(primary: DataFrame, replay: DataFrame, key: str | None, order_by: list[str], columns: list[str]) -> DataFrame:
    """Row i of one side against row i of the other, within each key or, without one, of the whole tables: (key,) row, column, original, replay of unequal cells.

    A row without its counterpart differs in all of its cells from null. Rows of equal `order_by` are ordered by their cells, so that reruns
    agree. Tables and keys of any size are numbered range by range, and rows meet by their number, so no task sees more than its share.
    """
    keys = [key] if key else []

    def placed(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])
        rows = df.select(*keys, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], cells.alias(side))
        # Rows that are equal throughout may take each other's places; the last key spreads them over ranges.
        order = [*[F.col(f"_o{i}") for i in range(len(order_by))], F.col(side), F.monotonically_increasing_id()]
        return (numbered_within(rows, key, order, "row") if key else numbered(rows, order, "row")).select(*keys, "row", side)

    left, right = placed(primary, "original"), placed(replay, "replay").withColumnsRenamed({c: f"_{c}" for c in [*keys, "row"]})
    both = left.join(right, functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "row"]]), "full")
    names = F.array(*[F.lit(c) for c in columns])
    cells = F.transform(names, lambda n, i: F.struct(n.alias("column"), F.get("original", i).alias("original"), F.get("replay", i).alias("replay")))
    found = both.select(*[F.coalesce(c, f"_{c}").alias(c) for c in [*keys, "row"]], F.explode(cells).alias("c"))
    return found.select(*keys, "row", "c.*").where("not (original <=> replay)")


def cells_of(pairs: DataFrame, key: str, side: str) -> DataFrame:
    """The long form of one side's results: key, row, position, column, value."""
    rows = pairs.select(key, F.coalesce(f"{side}_columns", F.array().cast("array<string>")).alias("names"), F.posexplode(f"{side}_rows").alias("row", "cells"))
    return rows.select(key, "row", "names", F.posexplode("cells").alias("position", "value")).select(key, "row", "position", F.get("names", F.col("position")).alias("column"), "value")


#: Shares of a pair's cells: a pair meets its shape in so many tasks.
SHARES = 32


def long_differences(meta: DataFrame, original_cells: DataFrame, replay_cells: DataFrame, key: str, ignore_columns: list[str] | None = None) -> DataFrame:
    """The decision procedure on cells in long form, for results too large to nest: a row per difference, (key, type, row, position, column, original, replay).

    `meta` has a row per pair with errors, affected rows, names, and n_original and n_replay rows. Cells meet by key, row
    and position, so those of one pair are spread over all tasks. `position` is a cell's, and null of other differences.
    """
    n, m = _sides_of_counts()
    whole = meta.select(key, F.explode(_decided(n, m, F.array().cast(f"array<{DIFFERENCE}>"))).alias("d")).select(key, "d.type", F.col("d.row").cast("long").alias("row"), F.lit(None).cast("int").alias("position"), "d.column", "d.original", "d.replay")
    (error, other_error), (names, others) = _sides("error", ""), _names()
    alike = (error == "") & (other_error == "") & (F.size(names) == F.size(others)) & (n == m)
    shares = meta.where(alike).select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_of"))
    skip = F.coalesce(F.col("column").isin(ignore_columns or []), F.lit(False))
    left = original_cells.where(~skip).select(key, "row", "position", F.coalesce("column", F.lit("")).alias("column"), F.coalesce("value", F.lit("NULL")).alias("original"))
    right = replay_cells.select(key, "row", "position", F.coalesce("value", F.lit("NULL")).alias("replay"))
    cells = left.join(right, [key, "row", "position"], "left").withColumn("replay", F.coalesce("replay", F.lit("NULL"))).where("original != replay")
    share = F.pmod(F.xxhash64("row", "position"), F.lit(SHARES)).cast("int")
    cells = cells.withColumn("_share", share).join(shares, (F.col(key) == F.col("_key")) & (F.col("_share") == F.col("_of")))
    return whole.unionByName(cells.select(key, F.lit("cell_value").alias("type"), F.col("row").cast("long").alias("row"), F.col("position").cast("int").alias("position"), "column", "original", "replay"))


def _sides_of_counts() -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(0)) for c in ("n_original", "n_replay")]


def difference_counts(meta: DataFrame, differences: DataFrame, key: str) -> DataFrame:
    """For every pair: match, how many differences it has, and how many rows and columns they are in."""
    rows = F.count_distinct(F.when(F.col("type") == "cell_value", F.col("row")))
    found = differences.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), rows.alias("n_rows"), F.collect_set("type").alias("types"))
    out = meta.select(key).join(found, F.col(key) == F.col("_key"), "left")
    return out.select(key, F.col("n").isNull().alias("match"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_rows")], F.coalesce(F.array_sort("types"), F.array().cast("array<string>")).alias("types"))


#: The order of the kinds of differences of a pair.
_KINDS = ["error", "affected_rows", "column_count", "column_name", "row_count", "cell_value"]


def _order() -> list[Column]:
    return [F.array_position(F.array(*[F.lit(k) for k in _KINDS]), F.col("type")), F.col("row"), F.col("position"), F.col("column")]


def difference_pages(differences: DataFrame, key: str, rows: int = 1000) -> DataFrame:
    """A pair's differences in pages of so many rows of its result: (key, page, n, differences in order). No page grows with the pair."""
    page = F.floor(F.col("row") / rows)
    each = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_order())], "type", "row", "column", "original", "replay")
    found = differences.groupBy(key, page.alias("page")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(each)).alias("d"))
    return found.select(key, "page", "n", F.transform("d", lambda d: F.struct(*[d[c].alias(c) for c in ("type", "row", "column", "original", "replay")])).alias("differences"))


def first_differences(differences: DataFrame, key: str, n: int = 20, rows: int = 1000) -> DataFrame:
    """The first n differences of each pair, for display, with their `rank`: picked from each page, and then from what the pages left."""
    paged = differences.withColumn("_page", F.floor(F.col("row") / rows))
    for by in ([key, "_page"], [key]):
        paged = paged.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*_order()))).where(F.col("rank") <= n)
    return paged.drop("_page")


def offline_compare(log: DataFrame, captured: DataFrame, compare_rows_returned: bool = False) -> DataFrame:
    """A log against captured replays. The log knows errors, affected rows and time, but no result.

    So every statement that returns columns differs in their count, unless `compare_rows_returned`: then
    the logged number of rows is compared instead.
    """
    text = "array<string>"
    pairs = pair_results(log, captured).withColumns({"original_columns": F.array().cast(text), "original_rows": F.array().cast(f"array<{text}>")})
    if not compare_rows_returned:
        return compare_results(pairs)
    counted = F.coalesce("rows_returned", F.lit(0))
    out = compare_results(pairs.withColumns({"_columns": F.col("replay_columns"), "_rows": F.col("replay_rows"), "replay_columns": F.array().cast(text), "replay_rows": F.array().cast(f"array<{text}>")}))
    (error, other_error), n = _sides("error", ""), F.greatest(F.size("_rows"), F.lit(0))
    other = F.when((error == "") & (other_error == "") & (counted != n), _one("row_count", counted, n))
    out = out.withColumn("differences", F.concat("differences", F.coalesce(other, F.array().cast(f"array<{DIFFERENCE}>"))))
    return out.withColumn("match", F.size("differences") == 0).withColumns({"replay_columns": F.col("_columns"), "replay_rows": F.col("_rows")}).drop("_columns", "_rows")


def classify_errors(results: DataFrame) -> DataFrame:
    """Errors by digest: those that the server returned, and those of the connection."""
    from .sessions import is_transport_error

    kind = F.when(is_transport_error(F.col("error")), "transport").otherwise("sql")
    return results.where("error != ''").groupBy(statements.digest(F.col("query")).alias("digest"), kind.alias("kind")).agg(F.count("*").alias("count"))
