"""What several of the operators share: the shared folder, row packing, hold-out rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltraffic.scratch import scratch_dir

#: White space of the contracts, as a character class body: space and U+0009 to U+000D.
BLANKS = r"\x20\x09-\x0D"
#: A word of the contracts.
WORD = rf"[^{BLANKS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir)."""
    return scratch_dir(spark, name)


#: Spark's setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The tables that pass, of the work that this thread (or whoever hands its context on) is at.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """What is settled inside is deleted at the end, but for tables that stay: those that the outcome is read from.

    Tables that other threads settle meanwhile are theirs, and stay.
    """
    mine: list[str] = []
    token = _passing.set(mine)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, mine):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_cleaning: dict[str, tuple[int, str]] = {}
_lock = Lock()


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their execution while anything is inside; the last one out puts the session's own setting back."""
    name = str(spark._jsparkSession.sessionUUID())
    with _lock:
        inside, before = _cleaning.get(name, (0, spark.conf.get(CLEANUP)))
        _cleaning[name] = inside + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            inside, before = _cleaning.pop(name)
            if inside > 1:
                _cleaning[name] = inside - 1, before
            else:
                spark.conf.set(CLEANUP, before)


def settled(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost
    executor costs no more than its own tasks. Tables with whole texts are a good part of the disk, so they are packed well.

    The shuffle files behind the table go when it is written; the table itself goes with the passing tables that it is one of.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with _cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    passing = _passing.get()
    if passing is not None and not stays:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest_by_hash(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n different keys of each group whose hash comes first: a sample that reruns repeat.

    Only about 2 n keys of a group are shuffled, those whose hash lies below a bound set by its (approximate) number of
    keys; that fewer than n lie there has odds below 1e-50, and the sample is smaller then. Give it keys, not texts.
    """
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(key).alias("keys"))
    bound = sizes.select(group, (F.lit(2 * n + 200) / F.col("keys")).alias("share"))
    point = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    low = rows.select(group, key).join(F.broadcast(bound), group).where(point < F.col("share")).select(group, key).distinct()
    by_hash = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return low.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= n).drop("rank")


#: About how many bytes of rows go to a Python worker at once, and the session's setting for that with Spark's own value.
BATCH_BYTES = 4 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def text_batches(rows: DataFrame) -> DataFrame:
    """Rows that go to Python workers in batches of about BATCH_BYTES (or of one row), where the session has Spark's own bound.

    Batches of whole texts take memory thrice: as the JVM's vectors, on their way, and in the worker.
    """
    spark = rows.sparkSession
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return rows


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task, one thing at a time: the next operator's takes the place of the last one's."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Lets go of what a worker has kept. Operators that keep nothing call it where their work on texts begins, since workers live on from stage to stage."""
    _kept.clear()


def portions(batches: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array], stride: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `stride` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(text(batch)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // stride
        edges = [*np.flatnonzero(np.diff(part, prepend=-1)), len(sizes)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(low, high - low)


def scored(docs: DataFrame, text: str, score: Callable[[pa.Array], list[pa.Array]], fields: T.StructType) -> DataFrame:
    """Each row, packed whole as `row`, and what `score` gives for the texts of a portion."""
    at = docs.columns.index(text)
    schema = T.StructType([T.StructField("row", docs.schema), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, lambda b: b.column(0).field(at)):
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *score(row.field(at))], names=schema.names)

    return text_batches(docs.select(F.struct("*").alias("row"))).mapInArrow(run, schema)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Rows with their group's columns, by a left join on `key`; `groups` has a row for each key and its number of rows in `size`.

    Keys of more than a thousandth of all rows are under a thousand, so their groups are broadcast and their rows stay
    where they are. The others are joined by a shuffle. A null key joins nothing.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    large = F.col(size) > total / 1000
    names = [c for c in groups.columns if c != key]
    hot = F.broadcast(groups.where(large).select(F.col(key).alias("_key"), F.struct(*names).alias("_group")))
    tagged = rows.join(hot, F.col(key) == F.col("_key"), "left")
    there = tagged.where("_key is not null").select(*[F.col(c) for c in rows.columns], *[F.col(f"_group.{c}").alias(c) for c in names])
    rest = tagged.where("_key is null").select(*rows.columns).join(groups.where(~large), key, "left").select(*rows.columns, *names)
    return there.unionByName(rest)
