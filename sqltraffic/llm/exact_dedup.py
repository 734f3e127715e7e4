"""Exact deduplication by two-pass Bloom filtering.

Every text is normalised and hashed once; SHA-256 stands for it from there on. Pass one sets a bit of a
Bloom filter for each hash; the bits that were set twice or more make up the filter (bloom.py, which states its
bound). Pass two tests every row against it, on the map side: a row whose bit is not there has no equal, and
passes straight through. Only the others are shuffled; groups that hold more than a thousandth of them are
joined by broadcast, so that no task gets a large group.

Texts are equal if they are the same after removal of all blanks (U+0020, U+0009 to U+000D).
A null text counts as empty, so null and blank texts are equal to each other. Of equal texts
the one with most code points stays, then the smallest doc_id (a null id comes first); of
rows that repeat with the same id and length, exactly one stays. An empty table gives an
empty result, and other columns, whatever their names, are carried through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import may_repeat
from .common import settled, with_groups


def normalised(text: Column) -> Column:
    left = F.coalesce(text, F.lit(""))
    for blank in " \t\n\x0b\x0c\r":
        left = F.replace(left, F.lit(blank), F.lit(""))
    return left


def _keys(doc_id: str, text: str) -> list[Column]:
    points = F.length(F.coalesce(F.col(text), F.lit("")))
    return [F.col(doc_id).alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("sha"), points.alias("points")]


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with `maybe`: whether another of the same sha may exist."""
    return may_repeat(rows, F.xxhash64("sha")).select("row.*", "maybe")


def _groups(maybe: DataFrame, *more: str) -> DataFrame:
    """sha, group_size and the best row's key of each group of equal texts."""
    return maybe.groupBy("sha").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("less"), "doc_id", *more)).alias("best"))


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, the dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = _marked(settled(docs.select(*_keys(doc_id, text), F.monotonically_increasing_id().alias("n")), "exact-keys"))
    maybe = keys.where("maybe").drop("maybe")
    both = with_groups(maybe, settled(_groups(maybe, "n"), "exact-groups"), "sha", "group_size").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("n") == F.col("best.n")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    alone = keys.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(both)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. They are written once with their keys, which the passes read without the texts.

    Of rows that repeat with the best's id and length, one is taken after a partial aggregation in each task.
    """
    rows = _marked(settled(docs.select(F.struct("*").alias("whole"), *_keys(doc_id, text)), "exact-rows"))
    best = settled(_groups(rows.where("maybe").select("sha", "points", "doc_id")), "exact-groups")
    placed = with_groups(rows.where("maybe").drop("maybe"), best, "sha", "group_size")
    stay = placed.where((F.col("points") == -F.col("best.less")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    stay = stay.groupBy("sha").agg(F.first("whole").alias("whole"))
    return rows.where("not maybe").select("whole.*").unionByName(stay.select("whole.*"))
