"""The job log as a stream: numbering and terminal events with keyed state, duplicates, windows, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from attestra.operators.joblog import IDLE_SECONDS, TERMINAL_EVENTS

#: Parts of the table of current jobs that are rewritten on their own.
BUCKETS = 64
#: How long an ended job is remembered.
KEPT_HOURS = 48
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NUMBERED = "job_id long, event_id long, event_type string, timestamp timestamp, kind string"


class Numbering(StatefulProcessor):
    """Keyed state of the job log: the last number of a job that runs (one value), whether it has ended (one value, which Spark lets go `kept` milliseconds
    later), and a timer for the next keep-alive row of a job that runs. A running job's number has no end of life, so that numbers stay free of gaps
    however long it is silent."""

    def __init__(self, idle: int, kept: int):
        self.idle, self.kept = idle, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")
        self.ended = handle.getValueState("ended", "ended boolean", self.kept)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # Each question to a state goes over a socket and back: a job that runs has not ended, and one that does not run has no timer.
        running = self.last.get()
        if running is None and self.ended.exists():
            return
        last, ended = running[0] if running else 0, False
        for frame in rows:
            if ended:
                continue
            order = np.lexsort((frame["source_id"].to_numpy(), frame["timestamp"].to_numpy()))
            kinds, times = frame["event_type"].to_numpy()[order], frame["timestamp"].to_numpy()[order]
            ends = next((i for i, kind in enumerate(kinds) if kind in TERMINAL_EVENTS), None)
            ended = ends is not None
            n = ends + 1 if ended else len(kinds)
            yield pd.DataFrame({"job_id": key[0], "event_id": range(last + 1, last + 1 + n), "event_type": kinds[:n], "timestamp": times[:n], "kind": "event"})
            last += n
        if running is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
        if ended:
            self.ended.update((True,))
            if running is not None:
                self.last.clear()
        else:
            self.last.update((last,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        running = self.last.get()
        if running is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
            yield pd.DataFrame({"job_id": [key[0]], "event_id": [running[0]], "event_type": [None], "timestamp": [pd.NaT], "kind": ["keep_alive"]})

    def close(self) -> None:
        """Nothing is held outside the state store."""


def numbered_stream(events: DataFrame, idle_seconds: int = IDLE_SECONDS, kept_hours: int = KEPT_HOURS) -> DataFrame:
    """Gap-free numbers by arrival, nothing behind a terminal event, and a keep-alive row after every idle_seconds in which a running job is silent.

    events: job_id, source_id, event_type, timestamp. State is two values a job; that of an ended one goes after kept_hours, within which late
    events of it are dropped. Started streams keep their state in RocksDB, which Spark asks for here; a stream that goes on from an older checkpoint keeps
    its own store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("job_id").transformWithStateInPandas(Numbering(idle_seconds * 1_000, kept_hours * 3_600_000), NUMBERED, "append", "processingTime")


def run_to_end(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a stream with timers over what is there, and end. Timers make Spark start batch after batch without data, which `availableNow` would wait
    for; the query takes the setting with it when it starts, and the session's own is put back."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    own = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, own)
    query.awaitTermination()


def deduplicated_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["job_id", "event_id"])


def windowed_stream(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    counts = events.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions_stream(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    spans = events.withWatermark("timestamp", delay).groupBy("job_id", F.session_window("timestamp", gap).alias("s")).agg(F.count("*").alias("events"))
    return spans.select("job_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def _latest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """The rows of each bucket's newest version below `before`, with bucket and version; None where there is nothing yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    rows = spark.read.parquet(path).where(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"])  # BUCKETS rows at most


def read_jobs(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest row of each job that upsert_jobs() has written."""
    rows = _latest(spark, path, 1 << 62)
    return None if rows is None else rows.drop("bucket", "version")


def upsert_jobs(path: str):
    """A foreachBatch writer: the newest row of each job so far, by buckets of jobs. A batch writes a new version of the buckets that it
    touches, BUCKETS at most, and then deletes all older versions but one, so that a batch that runs again finds what it began with."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c != "job_id"]
        newer = batch.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int"))
        touched = sorted(r["bucket"] for r in newer.select("bucket").distinct().collect())
        if not touched:
            return
        before = _latest(spark, path, number)
        if before is not None:
            newer = newer.unionByName(before.where(F.col("bucket").isin(touched)).select(*newer.columns))
        merged = newer.groupBy("bucket", "job_id").agg(F.max_by(F.struct(*columns), "seq").alias("j")).select("bucket", F.lit(number).cast("long").alias("version"), "job_id", "j.*")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        for bucket in touched:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            versions = sorted(int(name[8:]) for e in files.listStatus(folder) if (name := e.getPath().getName()).startswith("version="))
            for version in [v for v in versions if v < number][:-1]:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}/version={version}"), True)

    return write
