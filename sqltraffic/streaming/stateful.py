"""Streams whose operators keep state with timers of the log's own time, chained in one query.

They need the state store that has timers and several tables of state; start such a query inside `timed_state`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sqltraffic.functions import statements
from sqltraffic.operators.metrics import beat_counts

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB; those that run already keep what they have."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


# --- heartbeats ------------------------------------------------------------------------------
BEATS = ["total", "matched", "differed", "ignored"]
_BEAT = "ms long, " + ", ".join(f"window_{n} long" for n in BEATS) + ", cumulative_total long, cumulative_differed long"
#: Idle beats that are put out in one frame.
FRAME = 10_000


class Beats(StatefulProcessor):
    """Beats in order of time, with a zero for every idle interval, and running totals. State is three numbers."""

    def __init__(self, step_ms: int):
        self.step = step_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("beats", "next long, total long, differed long")

    def _frames(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for low in range(0, len(rows), FRAME):
            yield pd.DataFrame(rows[low : low + FRAME], columns=["ms", *[f"window_{n}" for n in BEATS], "cumulative_total", "cumulative_differed"])

    def _idle(self, start: int, end: int, total: int, differed: int) -> Iterator[pd.DataFrame]:
        """A zero for each interval that begins from start to before end."""
        for low in range(start, end, FRAME * self.step):
            yield from self._frames([(ms, 0, 0, 0, 0, total, differed) for ms in range(low, min(end, low + FRAME * self.step), self.step)])

    def _wait(self, due: int, total: int, differed: int) -> None:
        """The next beat begins at `due`; it is put out as idle once the watermark has passed its end."""
        self.state.update((due, total, differed))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due + self.step)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, total, differed = self.state.get() if self.state.exists() else (None, 0, 0)
        for row in pd.concat(rows).sort_values("ms").itertuples():
            if due is not None and row.ms > due:
                yield from self._idle(due, row.ms, total, differed)
            total, differed = total + row.window_total, differed + row.window_differed
            yield from self._frames([(row.ms, *[getattr(row, f"window_{n}") for n in BEATS], total, differed)])
            due = row.ms + self.step
        if due is not None:
            self._wait(due, total, differed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due, total, differed = self.state.get()
        over = (timerValues.getCurrentWatermarkInMs() - due) // self.step
        if over > 0:
            yield from self._idle(due, due + over * self.step, total, differed)
            due += over * self.step
        self._wait(due, total, differed)


def stream_heartbeats(results: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Heartbeats as metrics.heartbeats has them, once the watermark has passed them (append mode): idle intervals are beats too.

    Rows are counted by interval in all tasks; only beats, of which there are as many as intervals, go through one task.
    """
    counted = results.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(*beat_counts())
    one = counted.select(F.unix_millis("w.start").alias("ms"), *[f"window_{n}" for n in BEATS], F.lit(0).alias("k")).groupBy("k")
    beats = one.transformWithStateInPandas(Beats(seconds * 1000), _BEAT, "append", "EventTime")
    return beats.select(F.timestamp_millis("ms").alias("timestamp"), *[f"window_{n}" for n in BEATS], "cumulative_total", "cumulative_differed", F.lit("heartbeat").alias("type"), F.lit(seconds).alias("window_seconds"))


# --- gates, tracking and pairing in one query ------------------------------------------------
class Tracking(StatefulProcessor):
    """The temporary-table gate of one session: which names it has, until the session has been idle for so long."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tables = handle.getMapState("tables", "name string", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(rows).sort_values("seq")
        passes = []
        for row in batch.itertuples():
            ok = bool(row.safe or (row.write and row.target != "" and self.tables.containsKey((row.target,))))
            if row.created:
                self.tables.updateValue((row.created,), (int(row.seq),))
            elif row.dropped:
                self.tables.removeKey((row.dropped,))
            elif row.plain_drop and ok:
                self.tables.removeKey((row.target,))
            passes.append(ok)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        last = int(batch["ts"].max().timestamp() * 1000)
        self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle)
        yield batch.assign(passes=passes)[["session_id", "seq", "ts", "passes"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.tables.clear()
        return iter(())


def tracked(log: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """session_id, seq, ts and passes of a stream with a watermark on ts; ts keeps it for what follows."""
    query = F.col("query")
    kind = statements.category(query)
    safe = [statements.SELECT, statements.SESSION_STATE, statements.TEMP_TABLE, statements.TRANSACTION]
    rows = log.select(
        "session_id", "ts", F.col("seq").cast("long").alias("seq"), kind.isin(safe).alias("safe"), kind.isin(statements.DML, statements.DDL).alias("write"),
        statements.temp_created(query).alias("created"), statements.temp_dropped(query).alias("dropped"),
        statements.write_target(query).alias("target"), statements.is_plain_drop(query).alias("plain_drop"),
    )
    schema = "session_id long, seq long, ts timestamp, passes boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(Tracking(idle_ms), schema, "append", "EventTime", eventTimeColumnName="ts")


def stream_replayed(log: DataFrame, replay: DataFrame, gate: Column, timeout: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Gate, tracking and pairing as one query in append mode: statements that pass both gates, with their replay if one came in time.

    `gate` is the condition of the gates that look at a statement alone; what it stops is not tracked either. The watermark is handed on
    from the log to the tracking, and from there to the join.
    """
    passed = tracked(log.withWatermark("ts", late).where(gate)).where("passes")
    right = replay.select(F.col("session_id").alias("r_session"), F.col("seq").alias("r_seq"), "replay_ts", "replay_ms").withWatermark("replay_ts", late)
    within = F.expr(f"replay_ts >= ts AND replay_ts <= ts + interval {timeout}")
    return passed.join(right, (F.col("session_id") == F.col("r_session")) & (F.col("seq") == F.col("r_seq")) & within, "left_outer").select("session_id", "seq", "ts", "replay_ms")
