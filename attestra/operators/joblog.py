"""The append-only job log in batch: numbering, replay, states, recovery, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.sources.tables import written

# Stage and percent of progress, in order; terminal events and states.
STAGE_PROGRESS = (
    ("validating_uploads", 5), ("rendering_documents", 16), ("normalizing_pages", 27), ("aligning_reference", 39), ("extracting_text", 50),
    ("comparing_structure", 61), ("localizing_differences", 73), ("scoring_evidence", 84), ("preparing_result", 94), ("complete", 100),
)
TERMINAL_EVENTS, TERMINAL_STATES, ACTIVE_STATES = ("complete", "error"), ("completed", "failed"), ("queued", "running")
IDLE_SECONDS = 10
CHUNK_EVENTS = 1_000


def stage_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(STAGE_PROGRESS, 1)], "stage_no int, stage_id string, progress int")


def numbered(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Gap-free numbers from 1 within each job, by time and source id; they go on behind those that exist."""
    order = Window.partitionBy("job_id").orderBy("timestamp", "source_id")
    out = events.withColumn("event_id", F.row_number().over(order).cast("long"))
    if existing is not None:
        last = existing.groupBy("job_id").agg(F.max("event_id").alias("_last"))
        out = out.join(last, "job_id", "left").withColumn("event_id", F.col("event_id") + F.coalesce("_last", F.lit(0))).drop("_last")
    return out


def numbered_in_ranges(events: DataFrame) -> DataFrame:
    """As numbered(), for jobs of any size: events are dealt into ranges of job, time and source id, a range's jobs are counted, and the
    counts of the ranges in front are added to the numbers within a range. No task holds more of a job than one range."""
    order = ["job_id", "timestamp", "source_id"]
    dealt = written(events.repartitionByRange(*[F.col(c) for c in order]).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("job_id", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("job_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("job_id", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", "job_id").orderBy("timestamp", "source_id"))
    return dealt.withColumn("_own", own).join(offsets, ["job_id", "_range"]).withColumn("event_id", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def with_stage(events: DataFrame) -> DataFrame:
    """The stage and its progress by event number; numbers beyond the last stage keep it. The stage table has ten rows."""
    stages = F.broadcast(stage_table(events.sparkSession))
    return events.withColumn("stage_no", F.least("event_id", F.lit(len(STAGE_PROGRESS))).cast("int")).join(stages, "stage_no")


def cursor(query: Column, header: Column) -> Column:
    """struct<after, error>: the larger of two given cursors; one that is no whole number from 0 on is an error."""
    value = lambda c: F.when(c.isNull(), F.lit(0)).otherwise(c.try_cast("long"))
    a, b = value(query), value(header)
    bad = a.isNull() | b.isNull() | (a < 0) | (b < 0)
    return F.struct(F.when(~bad, F.greatest(a, b)).alias("after"), F.when(bad, "invalid_event_cursor").alias("error"))


def replay(events: DataFrame, after: int) -> DataFrame:
    return events.where(F.col("event_id") > after).orderBy("job_id", "event_id")


def latest(events: DataFrame, *columns: str) -> DataFrame:
    """The last event of each job, nulls included."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("event_id", *columns), "event_id").alias("e")).select("job_id", "e.*")


def until_terminal(events: DataFrame) -> DataFrame:
    """Events up to and with a job's first terminal one."""
    before = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.col("event_type").isin(*TERMINAL_EVENTS)).over(before)
    return events.withColumn("_ended", ended).where(~F.coalesce("_ended", F.lit(False))).drop("_ended")


def current_jobs(updates: DataFrame) -> DataFrame:
    """Last write wins, whole rows: a result or an error that the last write leaves unset is null."""
    columns = [c for c in updates.columns if c not in ("job_id", "seq")]
    return updates.groupBy("job_id").agg(F.max_by(F.struct("seq", *columns), "seq").alias("j")).select("job_id", "j.*")


def monotone(events: DataFrame) -> DataFrame:
    """Progress that never falls, and the last preview address so far."""
    so_far = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({"shown_progress": F.max("progress").over(so_far), "shown_url": F.last("candidate_page_url", ignorenulls=True).over(so_far)})


def deduplicated(events: DataFrame) -> DataFrame:
    """One row a job and event number: the first by time."""
    order = Window.partitionBy("job_id", "event_id").orderBy("timestamp")
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def idle_gaps(events: DataFrame, seconds: int = IDLE_SECONDS) -> DataFrame:
    """Events that came more than so many seconds behind the job's last one."""
    order = Window.partitionBy("job_id").orderBy("event_id")
    gap = (F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(order))) / 1e6
    return events.withColumn("gap_seconds", gap).where(F.col("gap_seconds") > seconds)


def activity_spans(events: DataFrame, gap: str) -> DataFrame:
    spans = events.groupBy("job_id", F.session_window("timestamp", gap).alias("s")).agg(F.count("*").alias("events"))
    return spans.select("job_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def recover(jobs: DataFrame, events: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, new events): queued and running jobs failed with `service_restarted`, one error event each; a second run finds none."""
    stopped = F.col("state").isin(*ACTIVE_STATES)
    columns = {"state": F.when(stopped, "failed").otherwise(F.col("state")), "error_code": F.when(stopped, "service_restarted").otherwise(F.col("error_code"))}
    last = events.groupBy("job_id").agg(F.max("event_id").alias("_last"))
    new = jobs.where(stopped).select("job_id").join(last, "job_id", "left")
    new = new.select("job_id", (F.coalesce("_last", F.lit(0)) + 1).alias("event_id"), F.lit("error").alias("event_type"), F.to_timestamp(F.lit(now)).alias("timestamp"))
    return jobs.withColumns(columns), new


def expired(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Ended jobs last updated before the cutoff; active ones never."""
    return jobs.where(F.col("state").isin(*TERMINAL_STATES) & (F.col("updated_at") < cutoff))


def cascade_delete(expired_jobs: DataFrame, files_gone: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Each table without the rows of expired jobs whose files are gone; the others stay for another try."""
    gone = expired_jobs.select("job_id").join(files_gone.select("job_id"), "job_id", "left_semi").distinct()
    return tuple(t.join(gone, "job_id", "left_anti") for t in tables)


def assets(registered: DataFrame) -> DataFrame:
    """Insert or replace: the last registration of each job and asset."""
    order = Window.partitionBy("job_id", "asset_id").orderBy(F.desc("seq"))
    return registered.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def resolve(requests: DataFrame, registry: DataFrame) -> DataFrame:
    return requests.join(registry.select("job_id", "asset_id", "relative_path", "media_type"), ["job_id", "asset_id"], "left")


def with_preview(jobs: DataFrame, registry: DataFrame, prefix: str = "/api/v1") -> DataFrame:
    own = registry.where("asset_id = 'candidate-page'").select("job_id").distinct().withColumn("_has", F.lit(True))
    url = F.when(F.col("_has"), F.concat(F.lit(f"{prefix}/analyses/"), F.col("job_id").cast("string"), F.lit("/assets/candidate-page")))
    return jobs.join(own, "job_id", "left").withColumn("candidate_page_url", url).drop("_has")


def job_durations(events: DataFrame) -> DataFrame:
    seconds = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6
    return events.groupBy("job_id").agg(seconds.alias("seconds"), F.count("*").alias("events"))


def stage_durations(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("job_id").orderBy("event_id")
    seconds = (F.unix_micros(F.lead("timestamp").over(order)) - F.unix_micros("timestamp")) / 1e6
    return events.withColumn("seconds", seconds)


def tumbling_counts(events: DataFrame, width: str) -> DataFrame:
    counts = events.groupBy(F.window("timestamp", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n")


def format_records(events: DataFrame) -> DataFrame:
    """job_id and the text of each event: `id:`, `event:` and `data:` lines and a blank one."""
    data = F.to_json(F.struct(*[c for c in events.columns if c != "event_type"]))
    text = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), F.col("event_type"), F.lit("\ndata: "), data, F.lit("\n\n"))
    return events.select("job_id", "event_id", text.alias("record"))


def streams(records: DataFrame, size: int = CHUNK_EVENTS) -> DataFrame:
    """job_id, chunk and stream: the records of a job by number, in texts of at most so many event numbers."""
    chunks = records.withColumn("chunk", F.expr(f"event_id div {size}")).groupBy("job_id", "chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "record"))), lambda r: r.record), "")
    return chunks.agg(joined.alias("stream"))


def parse_records(streams: DataFrame, text: str = "stream") -> DataFrame:
    """event_id, event_type and data of every record in texts of records."""
    parts = streams.select(F.explode(F.split(text, "\n\n")).alias("r")).where("trim(r) <> ''")
    line = lambda name: F.regexp_extract("r", rf"(?m)^{name}: ?(.*)$", 1)
    return parts.select(line("id").try_cast("long").alias("event_id"), line("event").alias("event_type"), line("data").alias("data"))


def conforming(events: DataFrame) -> DataFrame:
    """Per job: whether its numbers are gap free, and its stages in order of their first events. An array holds a job's stages, not its events."""
    each = events.groupBy("job_id", "stage_no").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n"))
    seen = F.transform(F.array_sort(F.collect_list(F.struct("first", "stage_no"))), lambda s: s.stage_no)
    out = each.groupBy("job_id").agg(F.max("last").alias("last"), F.min("first").alias("first"), F.sum("n").alias("n"), seen.alias("seen"))
    return out.select("job_id", ((F.col("last") == F.col("n")) & (F.col("first") == 1)).alias("contiguous"), (F.col("seen") == F.array_sort("seen")).alias("in_order"))
