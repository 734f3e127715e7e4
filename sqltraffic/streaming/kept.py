"""Streams into tables that stay small and can be read at any time: samples, sketches, reports, and late rows."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from sqltraffic.operators import sketches
from sqltraffic.operators.stats import least_by
from sqltraffic.streaming.jobs import each_batch


def _fs(spark: SparkSession, path: str):
    """The file system that a path is on, and a way to make paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


# --- samples ---------------------------------------------------------------------------------
def stream_sample(rows: DataFrame, by: Column, ties: list[str], k: int, checkpoint: str, table: str) -> StreamingQuery:
    """The k rows of each digest of least `by` so far (a hash of the row's own keys): a sample drawn evenly, that reruns repeat.

    Each batch's version of the table is made of the last one's and the batch; both have at most k rows a digest when they meet.
    A batch that runs again starts from the same version. The last two are kept.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = least_by(batch.withColumn("by", by), k, "by", *ties)
        fs, at = _fs(spark, table)
        last = f"{table}/version={number - 1}"
        if number and fs.exists(at(last)):
            fresh = least_by(spark.read.schema(fresh.schema).parquet(last).unionByName(fresh), k, "by", *ties)
        fresh.write.mode("overwrite").parquet(f"{table}/version={number}")
        fs.delete(at(f"{table}/version={number - 2}"), True)

    return each_batch(rows, work, checkpoint)


def read_sample(spark: SparkSession, table: str) -> DataFrame:
    """The newest version that is whole."""
    fs, at = _fs(spark, table)
    versions = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at(table)) if fs.exists(at(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{table}/version={max(versions)}")


# --- sketches --------------------------------------------------------------------------------
def stream_sketches(results: DataFrame, checkpoint: str, table: str) -> StreamingQuery:
    """Sketches of each batch by hour and digest; sketches.merged puts them together when they are read. A batch run again is written over."""
    return each_batch(results, lambda batch, number: sketches.sketch_hours(batch).write.mode("overwrite").parquet(f"{table}/batch={number}"), checkpoint)


# --- a report of whole batches ---------------------------------------------------------------
def commit_batch(rows: DataFrame, number: int, out: str) -> None:
    """Writes a batch to a folder of its own, and names that in the report's manifest by one rename.

    A batch that was killed half-way has left a folder that no manifest names; one that was committed before is left as it is.
    """
    fs, at = _fs(rows.sparkSession, out)
    final = at(f"{out}/manifest/{number:010d}.json")
    if fs.exists(final):
        return
    folder = f"batch-{number}-{uuid.uuid4().hex}"
    rows.write.json(f"{out}/rows/{folder}")
    draft = at(f"{out}/drafts/{folder}.json")
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps({"batch": number, "folder": folder}).encode()))
    stream.close()
    fs.mkdirs(final.getParent())
    if not fs.rename(draft, final):
        raise OSError(f"could not commit batch {number} to {out}")


def read_report(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The committed batches of a report, and no other rows."""
    fs, at = _fs(spark, f"{out}/manifest")
    if not fs.exists(at(f"{out}/manifest")):
        return spark.createDataFrame([], schema)
    named = spark.read.schema("batch long, folder string").json(f"{out}/manifest").collect()  # a row a batch
    return spark.read.schema(schema).json([f"{out}/rows/{r['folder']}" for r in named])


def stream_report(rows: DataFrame, checkpoint: str, out: str) -> StreamingQuery:
    """Rows of any shapes (differences and heartbeats, with nulls where a shape has no such column) as an exactly-once report."""
    return each_batch(rows, lambda batch, number: commit_batch(batch, number, out), checkpoint)


# --- late rows -------------------------------------------------------------------------------
class LateRows(StreamingQueryListener):
    """Counts the rows that stateful operators drop because the watermark has passed them, as metric rows.

    That is the watermark of the batch before: a row that only the newest one has passed still counts, and is not dropped.
    """

    def __init__(self, named: Callable[[str], str] | None = None):
        self.named, self.rows, self.running = named or (lambda name: name), [], set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.running.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        for i, op in enumerate(p.stateOperators):
            if op.numRowsDroppedByWatermark:
                stamp = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
                self.rows.append((stamp, self.named(p.name or str(p.id)), p.batchId, i, op.operatorName, op.numRowsDroppedByWatermark))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.running.discard(str(event.runId))

    def ended(self, seconds: float = 60) -> None:
        """Waits until the end of all streams that it has seen begin is known: their last counts come before that."""
        until = time.monotonic() + seconds
        while self.running and time.monotonic() < until:
            time.sleep(0.05)

    def table(self, spark: SparkSession) -> DataFrame:
        """ts, stream, batch, operator (its number and name), and the metric: name, kind, value."""
        rows = spark.createDataFrame(self.rows, "ts timestamp, stream string, batch long, number int, operator string, dropped long")
        return rows.select("ts", "stream", "batch", "number", "operator", F.lit("late_rows_dropped").alias("name"), F.lit("counter").alias("kind"), F.col("dropped").cast("double").alias("value"))
