"""Structured Streaming forms of the main series (R1-R5). A batch over the same rows gives the same result.

Each takes a stream of steps: session_id, step_id, ts (timestamp), model_id, tokens, and for R3 tool and status,
for R4 has_error. State goes with the watermark, LATE behind the newest step; rows that come later than that are
left out. Rows without a time are left out of R4 and R5, those without a session of R4.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestat.sources.shared import shared_folder
from lodestat.streaming.snapshot import Snapshot

LATE = "2 days"
#: A session without a step for so long, by the watermark, is closed.
IDLE_MS = 86_400_000
#: State that processors of their own need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by(steps: DataFrame, unit: str) -> DataFrame:
    """`steps` with `begin`, the start of a local day or hour in the session's time zone, whatever its length, as the event time.

    State of a day goes when a day begins that is LATE after it.
    """
    return steps.withColumn("begin", F.date_trunc(unit, "ts")).withWatermark("begin", LATE)


def daily_usage(steps: DataFrame) -> DataFrame:
    """Steps and tokens by local day and model."""
    sums = _by(steps, "day").groupBy("begin", "model_id").agg(F.count("*").alias("steps"), F.sum("tokens").alias("tokens"))
    return sums.select(F.to_date("begin").alias("day"), "model_id", "steps", "tokens")


def hourly_steps(steps: DataFrame) -> DataFrame:
    """R2: steps by local hour."""
    return _by(steps, "hour").groupBy("begin").agg(F.count("*").alias("steps")).select(F.col("begin").alias("hour_start"), "steps")


def tool_errors(tool_parts: DataFrame) -> DataFrame:
    """Calls and errors by local day."""
    sums = _by(tool_parts, "day").groupBy("begin").agg(F.count("*").alias("tool_calls"), F.count_if(F.col("status") == "error").alias("errors"))
    return sums.select(F.to_date("begin").alias("day"), "tool_calls", "errors")


class SessionStretch(StatefulProcessor):
    """Counts a session's steps and holds its last one, until no step came for `idle_ms`; then the session's state goes.

    A session that goes on after that begins another stretch, told from the first by its begin.
    """

    def __init__(self, step_type: str, idle_ms: int):
        self.step_type, self.idle_ms = step_type, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"begin long, steps long, at long, last_step {self.step_type}, last_has_error boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        begin, steps, at, last, error = self.held.get() if self.held.exists() else (None, 0, None, None, None)
        for some in rows:
            newest = some.sort_values(["at", "step_id"]).iloc[-1]
            begin = min(int(some["at"].min()), begin) if begin is not None and not steps else (begin if begin is not None else int(some["at"].min()))
            steps += len(some)
            if at is None or (int(newest["at"]), newest["step_id"]) > (at, last):
                at, last, error = int(newest["at"]), newest["step_id"], newest["has_error"]
        last = last.item() if hasattr(last, "item") else last
        error = None if error is None or pd.isna(error) else bool(error)
        self.held.update((begin, steps, at, last, error))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at // 1000 + self.idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "begin": [begin], "steps": [steps], "at": [at], "last_step": [last], "last_has_error": [error]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_stretches(steps: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """R4 as a stream: of each stretch of a session that has new steps, its number of steps and its last step (by time, then id); times are epoch microseconds.

    State is held for open sessions only.
    """
    rows = steps.where(F.col("ts").isNotNull() & F.col("session_id").isNotNull()).withWatermark("ts", LATE)
    rows = rows.select("session_id", "step_id", F.unix_micros("ts").alias("at"), "has_error", "ts")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"session_id {kinds['session_id']}, begin long, steps long, at long, last_step {kinds['step_id']}, last_has_error boolean"
    return rows.groupBy("session_id").transformWithStateInPandas(SessionStretch(kinds["step_id"], idle_ms), schema, "Update", "EventTime")


def session_status(stretches: DataFrame) -> DataFrame:
    """Each session's number of steps, last step and whether that has an error, from the newest rows of its stretches."""
    last = F.max_by(F.struct("last_step", "last_has_error"), F.struct("at", "last_step"))
    return stretches.groupBy("session_id").agg(F.sum("steps").alias("steps"), last.alias("r")).select("session_id", "steps", "r.last_step", "r.last_has_error")


def active_sessions(steps: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Stretches of a session's steps without a longer pause than `gap`, each once it is over (append); its state goes then. Steps without a session are one session."""
    w = F.session_window("ts", gap)
    return steps.withWatermark("ts", LATE).groupBy("session_id", w.alias("w")).agg(F.count("*").alias("steps")).select("session_id", F.col("w.start").alias("begin"), F.col("w.end").alias("until"), "steps")


def _run(stream: DataFrame, mode: str, folder: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs a stream over all rows there are now, in state that goes to RocksDB."""
    conf = stream.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STATE_STORE)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        conf.set(name, before)


def _folder(spark: SparkSession, folder: str | None) -> str:
    return folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def latest(stream: DataFrame, keys: list[str], folder: str | None = None, mode: str = "update") -> DataFrame:
    """Runs a stream over all rows there are now; of each key the row of the last micro-batch that had it, of earlier runs over the same folder too."""
    folder = _folder(stream.sparkSession, folder)
    kept = Snapshot(stream.sparkSession, f"{folder}/rows", keys, stream.schema)
    _run(stream, mode, folder, kept.merge)
    return kept.read()


def closed(steps: DataFrame, of: Callable[[DataFrame], DataFrame], keys: list[str], longest_ms: int, folder: str | None = None) -> DataFrame:
    """All rows of an append stream `of` steps with a column begin, those still open included: a last run moves the watermark past what was open.

    The run's rows come from a second source, a folder into which a row without a session is put whose time is the
    newest one, LATE and `longest_ms` later. What is open then is over, so it is for the end of a stream.
    """
    spark = steps.sparkSession
    folder = _folder(spark, folder)
    clock = f"{folder}/clock"
    spark.createDataFrame([], steps.schema).coalesce(1).write.mode("append").parquet(clock)
    told = steps.unionByName(spark.readStream.schema(steps.schema).parquet(clock))
    kept = Snapshot(spark, f"{folder}/rows", keys, (stream := of(told)).schema)
    newest = [p["eventTime"]["max"] for p in _run(stream, "append", folder, kept.merge).recentProgress if "max" in p["eventTime"]]
    if newest:
        last = F.to_timestamp(F.lit(max(newest)))
        end = last + F.expr(f"interval {LATE}") + F.make_dt_interval(secs=F.lit(longest_ms / 1000 + 1))
        row = spark.range(1).select(*(end.alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in steps.schema))
        row.write.mode("append").parquet(clock)
        _run(stream, "append", folder, lambda batch, number: kept.merge(batch.where(F.col("begin") < last + F.expr("interval 1 second")), number))  # what begins later is the clock's
    return kept.read()
