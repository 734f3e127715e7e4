"""Which rows may have an equal: a Bloom filter in two passes, by DataFrame functions alone.

Pass one sets one bit of a blocked filter for each row and keeps the bits that were set by two rows or
more. What it shuffles are numbers of bits, each once for a task at most, never rows. Pass two tests every
row where it is.

The filter has BITS_PER_ROW bits for a row up to MAX_BITS (32 MB), its proven bound when it is broadcast.
Beyond that it fills more densely: then more rows than needed may have an equal, and none is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW, MIN_BITS, MAX_BITS = 32, 1 << 18, 1 << 28
#: Bits in one block of the filter, as Spark's bitmap functions have it.
BLOCK = 32768


def filter_bits(rows: DataFrame) -> int:
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_ROW * rows.count()):
        bits *= 2
    return bits


def _block(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(bits // BLOCK))


def _bit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(BLOCK - 1))


def repeated_bits(rows: DataFrame, h: Column, bits: int) -> DataFrame:
    """Pass one: (block, bitmap) of the bits that more than one row has set."""
    twice = rows.select(_block(h, bits).alias("block"), _bit(h).alias("bit")).groupBy("block", "bit").count().where("count > 1")
    return twice.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def may_repeat(rows: DataFrame, h: Column, bits: int | None = None) -> DataFrame:
    """Pass two: the rows, packed as `row`, with `maybe`: whether a row of the same hash may exist. No row moves."""
    bits = bits or filter_bits(rows)
    filters = F.broadcast(repeated_bits(rows, h, bits))
    probed = rows.select(F.struct("*").alias("row"), _block(h, bits).alias("block"), _bit(h).alias("bit")).join(filters, "block", "left")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return probed.select("row", F.coalesce(is_set, F.lit(False)).alias("maybe"))
