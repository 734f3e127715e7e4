"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by hash, form a stream of tokens that repeats at
most EPOCHS times and is cut into blocks of equal size. A source gets as many slots of the mix
as its target fills blocks. Slots take their places by the van der Corput sequence: the points
j of 0..N-1 lie in the sources' cumulative slot counts, and the bit-reversed j is the point's
turn. So every stretch of the mix has the sources in proportion, a source's count is exact, and
its r-th slot takes its r-th block; the last block is cut where the target is met.

Prefix sums go in two levels (buckets of hashes, then rows of a bucket), so no window holds a
whole source. A null text has size 0, and documents of size 0 are taken 0 times. Sources come in
order of code points with null, a source of its own, last. Rows that repeat are documents of
their own. An empty table gives no rows; other columns are carried along or left out unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settled

#: Times that a source may be gone through.
EPOCHS = 3
#: Tokens in a block; slots in a run for the two-level ranks; cells of the point range.
BLOCK, RUN_BITS, CELL = 1024, 12, 4096
#: Hex digits of the shuffling hash that make a bucket.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and a row number `n`, written once for all that follows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return settled(rows.withColumn("n", F.monotonically_increasing_id()), "sizes")


def targets(sizes: DataFrame, period: int = 3) -> DataFrame:
    """source, number (in order), source_size, target. A row for each source.

    A source is full at EPOCHS times its size. With sources in order of that size by weight, the
    first k are full for the least k at which what is left, shared by weight, fits the next.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = found.withColumn("number", F.row_number().over(in_order) - 1).withColumn("weight", (F.col("number") % period + 1).cast("double"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    full = F.coalesce(F.sum(EPOCHS * F.col("source_size")).over(before), F.lit(0))
    shared = (total - full) / F.sum("weight").over(after)  # for a unit of weight, if those before are full
    fits = shared * F.col("weight") <= EPOCHS * F.col("source_size")
    staged = weighed.withColumns({"shared": shared, "fits": fits})
    # The first value that fits, by room, is the level of all that are not full.
    level = F.first(F.when(F.col("fits"), F.col("shared")), ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return staged.withColumn("target", F.least(level * F.col("weight"), (EPOCHS * F.col("source_size")).cast("double"))).select("source", "number", "source_size", "target")


def _starts(sizes: DataFrame) -> DataFrame:
    """Adds `at`: the tokens of its source that come before a document in shuffled order."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.withColumns({"hash": key, "bucket": F.substring(key, 1, BUCKET_DIGITS)})
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("inside"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "bucket", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("number", "bucket").orderBy("hash", "doc_id", "n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return rows.join(sums, ["number", "bucket"]).withColumn("at", F.col("base") + F.col("own")).drop("hash", "bucket", "own", "base")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: turn (their order), number (of the source), rank among its slots.

    `sources` has number and target, a row each.
    """
    spark = sources.sparkSession
    counts = sources.select("number", F.ceil(F.round("target") / block).cast("long").alias("slots")).where("slots > 0")
    upto = F.sum("slots").over(Window.orderBy("number"))
    counts = counts.select("number", (upto - F.col("slots")).alias("low"), upto.alias("high"))
    total = counts.agg(F.coalesce(F.max("high"), F.lit(0)).alias("n")).first()["n"]
    bits = max(1, (total - 1).bit_length()) if total else 1
    # A point finds its source by its cell: each source stands in the cells that it reaches into.
    cells = counts.select("*", F.explode(F.sequence(F.floor(F.col("low") / CELL), F.floor((F.col("high") - 1) / CELL))).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("j"), F.floor(F.col("id") / CELL).alias("cell"))
    turn = F.conv(F.rpad(F.reverse(F.bin("j")), bits, "0"), 2, 10).cast("long")
    slots = points.join(cells, "cell").where("low <= j and j < high").select("number", turn.alias("turn"))
    slots = slots.withColumn("run", F.shiftright("turn", RUN_BITS))
    runs = slots.groupBy("number", "run").agg(F.count("*").alias("inside"))
    earlier = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("number", "run", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("number", "run").orderBy("turn")) - 1
    return slots.withColumn("own", own).join(runs, ["number", "run"]).select("turn", "number", (F.col("base") + F.col("own")).alias("rank"))


def _turns(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each document and epoch: `from` and `to`, the tokens of its source's stream that it gives."""
    few = sources.select(F.col("source").alias("s"), "number", "source_size", F.round("target").cast("long").alias("goal"))
    # Sources are few against documents, but their number is not bounded: Spark picks the join by size.
    placed = _starts(sizes.where("size > 0").join(few, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source"))
    each = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    return each.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("at")).withColumn("to", F.least(F.col("from") + F.col("size"), F.col("goal")))


def mix(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix in parts: turn of the slot, n (row of the document), doc_id, epoch, skip and take (its words
    from where, how many)."""
    each = _turns(sizes, sources)
    parts = each.where("from < to").withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    low, high = F.greatest("from", F.col("rank") * block), F.least("to", (F.col("rank") + 1) * block)
    parts = parts.select("n", "doc_id", "number", "rank", "epoch", (low - F.col("from")).alias("skip"), (high - low).alias("take"))
    return parts.join(schedule(sources, block), ["number", "rank"]).select("turn", "n", "doc_id", "epoch", "skip", "take")


def taken_words(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = sized(docs)
    sources = settled(targets(sizes), "targets")
    taken = mix(sizes, sources, block).groupBy("n").agg(F.sum("take").alias("taken"))
    few = sources.select(F.col("source").alias("s"), "source_size", "target")
    rows = sizes.join(few, F.col("source").eqNullSafe(F.col("s"))).join(taken, "n", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix as documents, with all their columns, in the schedule's order: a row for each time that one is gone through.

    A document stands at the turn of the block that it begins in, whole, and so do its repeats in later epochs. Where a source's
    target ends inside a document, the text of that turn ends there too (n_chars, if there is such a column, follows).
    Documents that are not taken, and those of size 0, are left out.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = settled(rows.withColumn("n", F.monotonically_increasing_id()), "mix-rows")
    sizes = rows.select("doc_id", "source", "size", "n")
    sources = settled(targets(sizes), "targets")
    each = _turns(sizes, sources).where("from < to").select("n", "number", F.floor(F.col("from") / block).alias("rank"), "from", (F.col("to") - F.col("from")).alias("take"))
    placed = each.join(schedule(sources, block), ["number", "rank"]).select("n", "turn", "from", "take")
    mixed = rows.select("n", "row", "size").join(placed, "n").orderBy("turn", "from", "n")
    whole = F.col("take") == F.col("size")
    words = F.array_join(F.slice(F.regexp_extract_all(F.col("row")[text], F.lit(WORD), F.lit(0)), F.lit(1), F.col("take").cast("int")), " ")
    cut = F.when(whole, F.col("row")[text]).otherwise(words)
    columns = [cut.alias(c) if c == text else (F.when(whole, F.col("row")[c]).otherwise(F.length(words)).alias(c) if c == "n_chars" else F.col("row")[c].alias(c)) for c in docs.columns]
    return mixed.select(*columns)
