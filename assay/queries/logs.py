"""Run, attempt and progress logs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import runs
from assay.plans.sizing import estimated_bytes
from assay.queries import fixtures as X
from assay.queries.registry import Tables, query
from assay.session import scratch_dir
from assay.streaming import breaker, checksum, progress

ORDER = list(X.RUN_ORDER)


def _breaker_sql(reset_on_skip: bool, log: str = X.RUN_LOG) -> str:
    neutral = "FALSE" if reset_on_skip else "status = 'SKIP'"
    return X.with_(
        log,
        f"""marked AS (
  SELECT *, CASE WHEN {neutral} THEN 'neutral' WHEN status = 'FAIL' THEN 'fail' ELSE 'reset' END AS effect FROM run_log),
islands AS (
  SELECT *, sum(CAST(effect = 'reset' AS INT)) OVER w AS island FROM marked
  WINDOW w AS (PARTITION BY run_id ORDER BY position)),
streaks AS (
  SELECT *, sum(CAST(effect = 'fail' AS INT)) OVER (PARTITION BY run_id, island ORDER BY position) AS streak FROM islands),
stops AS (
  SELECT run_id, count(*) AS n_entries, min(position) FILTER (effect = 'fail' AND streak >= 5) AS stop_position
  FROM streaks GROUP BY run_id)""",
    )


def _shown(runs_table):
    """Runs that never stop are shown at position 0."""
    return runs_table.withColumn("stop_position", F.coalesce("stop_position", F.lit(0)))


@query(_breaker_sql(False) + "SELECT run_id, n_entries, coalesce(stop_position, 0) AS stop_position, coalesce(stop_position, n_entries) AS n_processed FROM stops")
def failure_circuit_breaker(t: Tables):
    return _shown(runs.failure_circuit_breaker(X.run_log(t), order=ORDER))


@query(_breaker_sql(True) + "SELECT run_id, n_entries, coalesce(stop_position, 0) AS stop_position, coalesce(stop_position, n_entries) AS n_processed FROM stops")
def failure_circuit_breaker_reset_on_skip(t: Tables):
    return _shown(runs.failure_circuit_breaker(X.run_log(t), order=ORDER, reset_on_skip=True))


@query(
    _breaker_sql(False, X.ONE_RUN_LOG)
    + "SELECT run_id, n_entries, coalesce(stop_position, 0) AS stop_position, coalesce(stop_position, n_entries) AS n_processed FROM stops"
)
def failure_circuit_breaker_one_run(t: Tables):
    # All events as one run, cut into slices as a run too long for one task would be.
    log = X.run_log(t).withColumn("run_id", F.lit(0).cast("bigint"))
    return _shown(runs.failure_circuit_breaker(log, order=ORDER, rows_per_task=_part(t)))


def _part(t: Tables) -> int:
    return max(1, t.events.count() // 12)


@query(
    _breaker_sql(False)
    + """SELECT run_id, event_id, s.position FROM streaks s JOIN stops USING (run_id)
         WHERE stop_position IS NULL OR s.position <= stop_position"""
)
def processed_entries(t: Tables):
    return runs.processed_entries(X.run_log(t), order=ORDER).select("run_id", "event_id", "position")


ATTEMPTS = X.with_(X.ERROR_LOG)


@query(
    """SELECT event_id, attempt, 1::BIGINT << CAST(least(attempt - 1, 5) AS INT) AS wait_s,
              CAST(sum(1::BIGINT << CAST(least(attempt - 1, 5) AS INT)) OVER (PARTITION BY user_id ORDER BY attempt) AS BIGINT) AS total_wait_s
       FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt
             FROM events WHERE event_type = 'error')"""
)
def retry_schedule(t: Tables):
    errors = t.events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return runs.retry_schedule(errors, "user_id", ["ts", "event_id"]).select(
        "event_id", "attempt", "wait_s", "total_wait_s"
    )


@query(
    ATTEMPTS
    + """, numbered AS (
  SELECT user_id AS entry, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, error_class FROM classified),
last AS (SELECT entry, max(attempt) AS attempts, arg_max(error_class, attempt) AS error_class FROM numbered GROUP BY entry)
SELECT entry, attempts, error_class, CASE WHEN error_class = 'DEVICE' THEN 'stop'
       WHEN attempts < 60 THEN 'retry' ELSE 'give_up' END AS verdict FROM last"""
)
def attempt_verdict(t: Tables):
    from assay.queries.columns import classified

    log = classified(t).select(F.col("user_id").alias("entry"), "event_id", "error_class")
    numbered = runs.number_rows(log, ["entry"], ["event_id"], "attempt")
    return runs.attempt_verdict(numbered, max_retries=60)


PROGRESS_STEPS = (
    """started AS (
  SELECT *, sum(CAST(kind = 'TotalBytes' AS INT)) OVER w AS island,
         coalesce(last_value(CASE WHEN kind = 'TotalBytes' THEN bytes END IGNORE NULLS) OVER w, 0) AS total_bytes
  FROM progress_log
  WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
summed AS (
  SELECT *, sum(CASE WHEN kind = 'BytesAdvanced' THEN bytes ELSE 0 END)
              OVER (PARTITION BY job_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS raw FROM started),
progressed AS (
  SELECT *, CAST(CASE WHEN total_bytes > 0 THEN least(raw, total_bytes) ELSE raw END AS BIGINT) AS completed_bytes FROM summed)""",
)
PROGRESS = X.with_(X.PROGRESS_LOG, *PROGRESS_STEPS)


@query(PROGRESS + "SELECT job_id, event_id, total_bytes, completed_bytes FROM progressed")
def running_progress(t: Tables):
    return runs.running_progress(X.progress_log(t), order=ORDER).select(
        "job_id", "event_id", "total_bytes", "completed_bytes"
    )


@query(X.with_(X.ONE_JOB_LOG, *PROGRESS_STEPS) + "SELECT event_id, total_bytes, completed_bytes FROM progressed")
def running_progress_one_job(t: Tables):
    log = X.progress_log(t).withColumn("job_id", F.lit(0).cast("bigint"))
    return runs.running_progress(log, order=ORDER, rows_per_task=_part(t)).select(
        "event_id", "total_bytes", "completed_bytes"
    )


LATEST = """SELECT job_id, arg_max(phase, event_id) FILTER (kind = 'Phase') AS phase,
                   arg_max(file, event_id) FILTER (kind = 'CurrentFile') AS current_file, count(*) AS n_events
            FROM progress_log GROUP BY job_id"""


@query(X.with_(X.PROGRESS_LOG) + LATEST)
def latest_state(t: Tables):
    return runs.latest_state(X.progress_log(t), order=ORDER)


@query(
    X.with_(X.PROGRESS_LOG)
    + """SELECT job_id, event_id, message, age FROM (
           SELECT user_id AS job_id, event_id, props AS message,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events)
         WHERE age <= 40"""
)
def log_tail(t: Tables):
    return runs.log_tail(X.progress_log(t), 40, order=ORDER).select("job_id", "event_id", "message", "age")


# Streams, run over the whole table until it is used up ------------------------------------

#: Micro-batches a table is streamed in, and the estimated bytes of one of its files.
MICRO_BATCHES, FEED_BYTES = 2, 32 << 20


def feed_files(frame) -> int:
    """Files that a frame is streamed from."""
    return max(MICRO_BATCHES * 2, -(-estimated_bytes(frame) // FEED_BYTES))


def _as_stream(t: Tables, frame, label: str):
    """The rows as a folder of files, oldest first, read back as a stream of several micro-batches; more rows make more files, not larger ones."""
    place = scratch_dir(t.spark, label)
    by = [column for column in ("ts", "event_id", "doc_id") if column in frame.columns]
    frame.repartitionByRange(feed_files(frame), *by).write.parquet(place)
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(place).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(s.getPath().toString() for s in fs.listStatus(path(place)) if s.getPath().getName().startswith("part"))
    for age, part in enumerate(parts):
        fs.setTimes(path(part), 1_600_000_000_000 + age * 1000, -1)
    return t.spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", -(-len(parts) // MICRO_BATCHES)).parquet(place)


JOB_STATE = (
    PROGRESS
    + """SELECT job_id, arg_max(phase, event_id) FILTER (kind = 'Phase') AS phase,
                arg_max(file, event_id) FILTER (kind = 'CurrentFile') AS current_file, arg_max(total_bytes, event_id) AS total_bytes,
                arg_max(completed_bytes, event_id) AS completed_bytes FROM progressed GROUP BY job_id"""
)


@query(JOB_STATE)
def progress_stream(t: Tables):
    states = scratch_dir(t.spark, "job-state")
    feed = _as_stream(t, X.progress_log(t), "progress-feed")
    progress.progress_stream(feed, states, order=ORDER).awaitTermination()
    return progress.current_state(t.spark, states).select("job_id", "phase", "current_file", "total_bytes", "completed_bytes")


APART = 6 * 3600


@query(
    PROGRESS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS position FROM progressed),
due(job_id, position, ts) AS (
  SELECT job_id, position, ts FROM placed WHERE position = 1
  UNION ALL
  SELECT p.job_id, p.position, p.ts
  FROM (SELECT d.job_id, min(p.position) AS position
        FROM due d JOIN placed p ON p.job_id = d.job_id AND p.position > d.position
        WHERE p.kind = 'Phase' OR epoch_us(p.ts) - epoch_us(d.ts) > {APART}000000 GROUP BY d.job_id) n
  JOIN placed p USING (job_id, position)),
states AS (
  SELECT job_id, position, ts, kind, total_bytes, completed_bytes,
         last_value(CASE WHEN kind = 'Phase' THEN phase END IGNORE NULLS) OVER w AS phase,
         last_value(CASE WHEN kind = 'CurrentFile' THEN file END IGNORE NULLS) OVER w AS current_file
  FROM placed WINDOW w AS (PARTITION BY job_id ORDER BY position ROWS UNBOUNDED PRECEDING))
SELECT job_id, s.position AS n_events, epoch_us(s.ts) AS at_us, kind = 'Phase' AS phase_changed, phase, current_file, total_bytes, completed_bytes
FROM due JOIN states s USING (job_id, position)"""
)
def throttled_updates(t: Tables):
    """The given events are hours apart, so updates are at most every six hours here."""
    place = scratch_dir(t.spark, "job-updates")
    feed = _as_stream(t, X.progress_log(t), "progress-feed")
    progress.throttled_updates(feed, place, order=ORDER, seconds=APART).awaitTermination()
    return progress.kept_rows(t.spark, place).select(
        "job_id", "n_events", F.unix_micros("at").alias("at_us"), "phase_changed", "phase", "current_file", "total_bytes", "completed_bytes"
    )


@query(_breaker_sql(False) + "SELECT run_id, stop_position FROM stops WHERE stop_position IS NOT NULL")
def stream_breaker(t: Tables):
    states = scratch_dir(t.spark, "run-state")
    feed = _as_stream(t, X.run_log(t), "run-feed")
    breaker.stream_breaker(feed, states, order=ORDER).awaitTermination()
    return breaker.tripped_runs(t.spark, states)


@query(X.with_(X.SOURCE) + "SELECT path, md5(payload) AS digest, size FROM source")
def stream_checksum(t: Tables):
    source = X.source_entries(t)
    target = scratch_dir(t.spark, "stream-manifest")
    feed = _as_stream(t, source.unionByName(source), "payload-feed")
    checksum.stream_checksum(feed, target).awaitTermination()
    return t.spark.read.parquet(target).select("path", "digest", "size")
