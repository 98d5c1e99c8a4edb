"""Attempt logs and progress logs: retries, circuit breaker, job state.

Runs and jobs may be of any length: running totals go through ``plans.scans`` and
everything else is an aggregate that combines before shuffling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.functions.errors import attempt_outcome
from assay.functions.numbers import INT64_MAX, backoff_seconds, cumulative_backoff
from assay.functions.paths import sanitize_name
from assay.plans.scans import SLICE, running, slice_groups
from assay.plans.sizing import ONE_TASK_ROWS
from assay.plans.skew import spread_join

FAILURE_LIMIT = 5


def number_rows(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, rows_per_task: int = ONE_TASK_ROWS
) -> DataFrame:
    """Add each row's 1-based position in its group."""
    sliced = slice_groups(df, groups, order, rows_per_task)
    return running(sliced, groups, order, {name: F.lit(1).cast("bigint")}).drop(SLICE)


def breaker_positions(
    log: DataFrame,
    run: str = "run_id",
    order: Sequence[str] = ("seq",),
    limit: int = FAILURE_LIMIT,
    reset_on_skip: bool = False,
    rows_per_task: int = ONE_TASK_ROWS,
    before: DataFrame | None = None,
) -> DataFrame:
    """The log with ``position``, ``streak`` (failures in a row so far) and ``trips``.

    ``status`` is OK, SKIP or FAIL; a failure whose ``error_class`` is DEVICE trips at
    once. A skipped entry ends a streak only with ``reset_on_skip``. ``before`` holds
    ``n_seen`` and ``open_streak`` of runs whose log began earlier.
    """
    groups = [run]
    fails = F.col("status") == "FAIL"
    resets = (F.col("status") == "OK") | (F.lit(reset_on_skip) & (F.col("status") == "SKIP"))
    based = running(
        slice_groups(log, groups, order, rows_per_task),
        groups,
        order,
        sums={"position": F.lit(1).cast("bigint"), "_fails": fails.cast("bigint")},
        sums_at={"_base": ("_fails", resets)},
    )
    streak = F.col("_fails") - F.coalesce("_base", F.lit(0))
    if before is not None:
        earlier = before.select(run, F.col("n_seen").alias("_seen"), F.col("open_streak").alias("_open"))
        based = spread_join(based, earlier, [run], "left")
        streak = streak + F.when(F.col("_base").isNull(), F.coalesce("_open", F.lit(0))).otherwise(0)
        based = based.withColumn("position", F.col("position") + F.coalesce("_seen", F.lit(0)))
    device = F.col("error_class") == "DEVICE" if "error_class" in log.columns else F.lit(False)
    return (
        based.withColumn("streak", streak)
        .withColumn("trips", fails & ((F.col("streak") >= limit) | F.coalesce(device, F.lit(False))))
        .drop("_fails", "_base", "_seen", "_open", SLICE)
    )


def failure_circuit_breaker(log: DataFrame, run: str = "run_id", **options) -> DataFrame:
    """Per run: entries logged, the position at which the run stops (NULL: never), entries processed."""
    stop = F.min(F.when(F.col("trips"), F.col("position")))
    return (
        breaker_positions(log, run, **options)
        .groupBy(run)
        .agg(F.count("*").alias("n_entries"), stop.alias("stop_position"))
        .withColumn("n_processed", F.coalesce("stop_position", "n_entries"))
    )


def processed_entries(log: DataFrame, run: str = "run_id", **options) -> DataFrame:
    """Log rows up to and including the one the breaker stops at."""
    placed = breaker_positions(log, run, **options)
    stops = placed.filter("trips").groupBy(run).agg(F.min("position").alias("stop_position"))
    joined = spread_join(placed, stops, [run], "left")
    return joined.filter("stop_position IS NULL OR position <= stop_position")


def retry_schedule(
    attempts: DataFrame, entry: str, order: Sequence[str], rows_per_task: int = ONE_TASK_ROWS
) -> DataFrame:
    """Number each entry's attempts and add the wait after each and the total wait so far."""
    numbered = number_rows(attempts, [entry], order, "attempt", rows_per_task)
    return add_waits(numbered)


def add_waits(attempts: DataFrame) -> DataFrame:
    """``wait_s`` and ``total_wait_s`` from ``attempt``; no shuffle."""
    attempt = F.col("attempt")
    return attempts.withColumns({"wait_s": backoff_seconds(attempt), "total_wait_s": cumulative_backoff(attempt)})


def attempt_verdict(attempts: DataFrame, max_retries: int = 3, unlimited: bool = False) -> DataFrame:
    """Per entry: attempts made, the last attempt's class, and what follows from it.

    ``attempts`` is ``(entry, attempt, error_class)`` with a NULL class for success.
    """
    last = F.max_by(F.col("error_class"), F.col("attempt"))
    made = attempts.groupBy("entry").agg(F.max("attempt").alias("attempts"), last.alias("error_class"))
    outcome = attempt_outcome(F.col("error_class"), F.col("attempts"), max_retries, unlimited)
    return made.withColumn("verdict", F.when(F.col("error_class").isNull(), "done").otherwise(outcome))


def quarantine_decision(failures: DataFrame) -> DataFrame:
    """``then`` for each failed entry: the record is always written; a device failure stops the run after it."""
    return failures.withColumn("then", F.when(F.col("error_class") == "DEVICE", "stop").otherwise("continue"))


def quarantine_rows(failures: DataFrame) -> DataFrame:
    """QUARANTINE rows with the report's file name."""
    name = F.concat(
        sanitize_name(F.col("source_relative")), F.lit("."), F.col("unix_time").cast("string"), F.lit(".failed.json")
    )
    return failures.select("source_relative", "attempts", "unix_time", "reason", name.alias("report_name"))


def quarantine_sequence(
    failures: DataFrame, run: str, order: Sequence[str], rows_per_task: int = ONE_TASK_ROWS
) -> DataFrame:
    """Per-run counter used in report names."""
    numbered = number_rows(failures, [run], order, "sequence", rows_per_task)
    return numbered.withColumn(
        "report_name",
        F.concat(
            F.lit("quarantine-"),
            (F.col("unix_time") * 1000).cast("string"),
            F.lit("-"),
            F.col("sequence").cast("string"),
            F.lit(".json"),
        ),
    )


def running_progress(
    events: DataFrame,
    job: str = "job_id",
    order: Sequence[str] = ("seq",),
    rows_per_task: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add ``total_bytes`` and ``completed_bytes`` as of each event.

    A TotalBytes event starts over; advances are non-negative, so holding the sum at the
    total equals holding it at every step. No total yet means no ceiling.
    """
    starts = F.col("kind") == "TotalBytes"
    advance = F.when(F.col("kind") == "BytesAdvanced", F.col("bytes")).otherwise(0).cast("decimal(38,0)")
    based = running(
        slice_groups(events, [job], order, rows_per_task),
        [job],
        order,
        sums={"_sum": advance},
        last={"_total": F.when(starts, F.col("bytes"))},
        sums_at={"_base": ("_sum", starts)},
    )
    total = F.coalesce("_total", F.lit(0)).cast("bigint")
    done = F.least(F.col("_sum") - F.coalesce("_base", F.lit(0)), F.lit(INT64_MAX)).cast("bigint")
    return based.withColumns(
        {"total_bytes": total, "completed_bytes": F.when(total > 0, F.least(done, total)).otherwise(done)}
    ).drop("_sum", "_total", "_base", SLICE)


def done_of_total(
    entries: DataFrame,
    order: Sequence[str] = ("path",),
    groups: Sequence[str] = (),
    rows_per_task: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add ``done`` of ``total`` counters in ``order``."""
    numbered = number_rows(entries, list(groups), order, "done", rows_per_task)
    if groups:
        totals = entries.groupBy(*groups).agg(F.count("*").alias("total"))
        return spread_join(numbered, totals, list(groups))
    return numbered.withColumn("total", F.lit(entries.count()).cast("bigint"))


def latest_state(events: DataFrame, job: str = "job_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Per job: the newest phase and file, and how many events were seen.

    A Cooldown phase clears the current file.
    """
    at = F.struct(*order)
    phase = F.max_by("phase", F.when(F.col("kind") == "Phase", at))
    touches_file = F.col("kind").isin("CurrentFile", "CooldownLeft")
    file = F.max_by(F.when(F.col("kind") == "CurrentFile", F.col("file")), F.when(touches_file, at))
    return events.groupBy(job).agg(
        phase.alias("phase"), file.alias("current_file"), F.count("*").alias("n_events")
    )


def log_tail(
    logs: DataFrame, keep: int, job: str = "job_id", order: Sequence[str] = ("seq",)
) -> DataFrame:
    """The newest ``keep`` lines of each job, numbered from the newest.

    Spark applies the rank limit before the shuffle too, so a task sends at most
    ``keep`` rows per job, whatever a job's share of the log. It does so up to a
    threshold; longer tails count positions from the front instead.
    """
    threshold = int(logs.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if keep > threshold:
        sizes = logs.groupBy(job).agg(F.count("*").alias("_n"))
        placed = spread_join(number_rows(logs, [job], order, "_position"), sizes, [job])
        placed = placed.withColumn("age", F.col("_n") - F.col("_position") + 1).drop("_n", "_position")
        return placed.filter(F.col("age") <= keep)
    newest = Window.partitionBy(job).orderBy(*[F.desc(column) for column in order])
    kept = logs.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= keep)
    return kept.withColumn("age", F.col("age").cast("bigint"))
