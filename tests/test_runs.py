import random

import pytest
from pyspark.sql import functions as F

from assay.operators import runs
from assay.plans.sizing import ONE_TASK_ROWS

LOG = "run_id int, seq long, status string, error_class string"


def breaker_by_hand(rows, limit, reset_on_skip):
    """The breaker applied to one run, entry by entry."""
    streak = 0
    for position, (status, cls) in enumerate(rows, start=1):
        if status == "FAIL":
            streak += 1
            if cls == "DEVICE" or streak >= limit:
                return position
        elif status == "OK" or reset_on_skip:
            streak = 0
    return None


def make_log(seed):
    """Run 0 owns more than a third of the log."""
    rng = random.Random(seed)
    lengths = {0: 400, **{run: rng.randint(1, 60) for run in range(1, 15)}}
    log = {}
    for run, length in lengths.items():
        device = rng.random() < 0.2
        log[run] = [
            (rng.choices(["FAIL", "OK", "SKIP"], [5, 3, 2])[0], "DEVICE" if device and rng.random() < 0.02 else "FILE")
            for _ in range(length)
        ]
    return log


@pytest.mark.parametrize("rows_per_task", [ONE_TASK_ROWS, 70])
@pytest.mark.parametrize("reset_on_skip", [False, True])
def test_breaker(spark, reset_on_skip, rows_per_task):
    log = make_log(seed=int(reset_on_skip))
    frame = spark.createDataFrame(
        [(run, seq * 3, *entry) for run, rows in log.items() for seq, entry in enumerate(rows)], LOG
    )
    for limit in (2, 5, 9):
        result = runs.failure_circuit_breaker(
            frame, limit=limit, reset_on_skip=reset_on_skip, rows_per_task=rows_per_task
        )
        expected = {run: breaker_by_hand(rows, limit, reset_on_skip) for run, rows in log.items()}
        assert {row.run_id: row.stop_position for row in result.collect()} == expected


def test_processed_entries_end_with_the_one_that_trips(spark):
    log = spark.createDataFrame(
        [(1, n, "FAIL" if n > 2 else "OK", None) for n in range(10)] + [(2, 0, "OK", None)], LOG
    )
    kept = runs.processed_entries(log, limit=3).groupBy("run_id").agg(F.max("seq").alias("last")).collect()
    assert {row.run_id: row.last for row in kept} == {1: 5, 2: 0}


def progress_by_hand(events):
    total = done = 0
    out = []
    for kind, size in events:
        if kind == "TotalBytes":
            total, done = size, 0
        elif kind == "BytesAdvanced":
            done += size
            if total > 0:
                done = min(done, total)
        out.append((total, done))
    return out


@pytest.mark.parametrize("rows_per_task", [ONE_TASK_ROWS, 60])
def test_running_progress(spark, rows_per_task):
    rng = random.Random(7)
    kinds = ["TotalBytes", "BytesAdvanced", "BytesAdvanced", "BytesAdvanced", "Log"]
    jobs = {job: [(rng.choice(kinds), rng.randint(0, 40)) for _ in range(300 if job == 0 else 25)] for job in range(8)}
    jobs[3] = [("BytesAdvanced", 5)] * 4
    frame = spark.createDataFrame(
        [(job, seq, kind, size * (5 if kind == "TotalBytes" else 1)) for job, rows in jobs.items() for seq, (kind, size) in enumerate(rows)],
        "job_id int, seq long, kind string, bytes long",
    )
    got = runs.running_progress(frame, rows_per_task=rows_per_task).collect()
    for job, rows in jobs.items():
        expected = progress_by_hand([(kind, size * (5 if kind == "TotalBytes" else 1)) for kind, size in rows])
        mine = sorted((r for r in got if r.job_id == job), key=lambda r: r.seq)
        assert [(r.total_bytes, r.completed_bytes) for r in mine] == expected


@pytest.mark.parametrize("rows_per_task", [ONE_TASK_ROWS, 50])
def test_counters(spark, rows_per_task):
    entries = spark.range(500).select(F.format_string("%05d", (F.col("id") * 7919) % 10007).alias("path"))
    rows = runs.done_of_total(entries, rows_per_task=rows_per_task).orderBy("path").collect()
    assert [row.done for row in rows] == list(range(1, 501))
    assert {row.total for row in rows} == {500}


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_log_tail_keeps_the_newest(spark, threshold):
    logs = spark.range(100).select((F.col("id") % 2).alias("job_id"), F.col("id").alias("seq"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        kept = runs.log_tail(logs, 3).collect()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert sorted((row.seq, row.age) for row in kept) == [(94, 3), (95, 3), (96, 2), (97, 2), (98, 1), (99, 1)]


def test_cooldown_clears_the_current_file(spark):
    events = spark.createDataFrame(
        [("j", 1, "Phase", "Copying", None), ("j", 2, "CurrentFile", None, "f"), ("j", 3, "CooldownLeft", None, None)],
        "job_id string, seq long, kind string, phase string, file string",
    )
    row = runs.latest_state(events).first()
    assert (row.phase, row.current_file, row.n_events) == ("Copying", None, 3)


def test_verdicts(spark):
    attempts = spark.createDataFrame(
        [("a", 1, "TRANSIENT"), ("a", 2, None), ("b", 1, "DEVICE"), ("c", 1, "FILE"), ("c", 2, "FILE"), ("c", 3, "FILE"), ("d", 1, "TRANSIENT")],
        "entry string, attempt int, error_class string",
    )
    got = {row.entry: row.verdict for row in runs.attempt_verdict(attempts).collect()}
    assert got == {"a": "done", "b": "stop", "c": "give_up", "d": "retry"}
