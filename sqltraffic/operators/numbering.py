"""Places of rows in an order, without one task that sees them all.

Rows are dealt by ranges of the order and sorted inside each; the table is written once with each row's
place in its range, the ranges are counted, and the counts before a range are added. Only as many
numbers as there are ranges are ordered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltraffic.scratch import scratch_dir

#: monotonically_increasing_id has the partition's number above this many bits, and the row's place in it below.
PLACE_BITS = 33


def range_of(at: str = "at") -> Column:
    return F.shiftright(at, PLACE_BITS)


def place_of(at: str = "at") -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows, packed as `row`, with the number of their range and their place in it, written and read again."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    path = scratch_dir(spark, "numbered")
    placed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select("row", range_of().alias("range"), place_of().alias("place"))


def numbered_ranges(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Written rows of several tables, told apart by `keys`, that kept their order in `at` (monotonically_increasing_id when written): `name`, from 0 in each."""
    ranges = rows.groupBy(*keys, range_of().alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*keys, "_range", before.alias("_before"))
    # There are as many ranges as tasks that wrote the tables.
    return rows.withColumn("_range", range_of()).join(F.broadcast(ranges), [*keys, "_range"]).withColumn(name, F.col("_before") + place_of()).drop("_range", "_before", "at")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with `name`: their place in the order, from 0.

    Rows that are equal in the order may take each other's places, and all go to one range: give an order that
    tells rows apart.
    """
    rows = _dealt(df, order)
    ranges = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(ranges.select("range", before.alias("before"))), "range").select("row.*", (F.col("before") + F.col("place")).alias(name))


def numbered_within(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """The rows with `name`: their place in the order among the rows of the same key (a null key is one too), from 0.

    A key of any size is dealt over as many ranges as its rows fill. Rows meet the counts before them by range and key,
    so no task gets more than a range's rows of one key.
    """
    rows = _dealt(df, [F.col(key), *order]).withColumn("key", F.col("row")[key])
    spans = rows.groupBy("range", "key").agg(F.min("place").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(F.col("range").alias("_range"), F.col("key").alias("_key"), "low", before.alias("before"))
    met = rows.join(spans, (F.col("range") == F.col("_range")) & F.col("key").eqNullSafe(F.col("_key")))
    return met.select("row.*", (F.col("before") + F.col("place") - F.col("low")).alias(name))
