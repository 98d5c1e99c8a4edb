"""Live job state from a stream of progress events, kept in Spark's own keyed state.

Events of a job have to arrive in order from batch to batch; within a batch they may be in
any order. A task holds one job's events of one micro-batch, so what a trigger admits
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bounds its memory, whatever the job's
share of the log. State and output are committed per micro-batch: a stream that is
started again with the same folder goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from assay.functions.numbers import INT64_MAX
from assay.session import ROCKSDB_PROVIDER

LOG_LINES = 300
#: Updates of a job that are not phase changes are at least this far apart.
UPDATE_SECONDS = 1.0

_STATE = "phase string, current_file string, total_bytes bigint, completed_bytes bigint, n_events bigint, log array<string>"
_FIELDS = [part.split()[0] for part in _STATE.split(", ")]
#: Timers are set to the millisecond; one that fires early would be set again.
_EARLY = 0.001


class JobState:
    """What the events seen so far say about one job."""

    def __init__(self, keep_lines: int, stored: Sequence | None = None):
        self.keep_lines = keep_lines
        self.phase, self.current_file, self.total, self.completed, self.n_events, log = stored or (None, None, 0, 0, 0, [])
        self.log = list(log)

    def add(self, kind: str, phase, size, file, message) -> None:
        self.n_events += 1
        if kind == "Phase":
            self.phase = phase
        elif kind == "TotalBytes":
            self.total, self.completed = int(size), 0
        elif kind == "BytesAdvanced":
            self.completed = min(self.completed + int(size), self.total if self.total > 0 else INT64_MAX)
        elif kind == "CurrentFile":
            self.current_file = file
        elif kind == "CooldownLeft":
            self.current_file = None
        elif kind == "Log":
            self.log.append(message)
            del self.log[: -self.keep_lines or None]

    def values(self) -> tuple:
        return self.phase, self.current_file, self.total, self.completed, self.n_events, self.log


def _in_order(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    frame = pd.concat(list(rows), ignore_index=True)
    return frame.sort_values(list(order), kind="stable")


def _events(frame: pd.DataFrame):
    columns = [frame[c] if c in frame else [None] * len(frame) for c in ("kind", "phase", "bytes", "file", "message")]
    missing = [None if isinstance(c, list) else c.isna() for c in columns]
    plain = [[None] * len(frame) if m is None else c.astype(object).mask(m, None) for c, m in zip(columns, missing, strict=True)]
    yield from zip(*plain, strict=True)


class FoldJobs(StatefulProcessor):
    """One row per job and micro-batch: the state after it."""

    def __init__(self, job: str, order: Sequence[str], keep_lines: int):
        self.job, self.order, self.keep_lines = job, list(order), keep_lines

    def init(self, handle) -> None:
        self.state = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows, timerValues):
        state = JobState(self.keep_lines, self.state.get())
        for event in _events(_in_order(rows, self.order)):
            state.add(*event)
        self.state.update(state.values())
        yield pd.DataFrame([(key[0], *state.values())], columns=[self.job, *_FIELDS])

    def close(self) -> None:
        pass


class ThrottleJobs(StatefulProcessor):
    """The updates to show: at once when the phase changes, else when the last one is over ``seconds`` old.

    With ``clock="event"`` time is the events' own ``ts``, and every update is the state as
    of the event that caused it. With ``clock="processing"`` it is the wall clock: a change
    that comes too early waits for a timer, so the newest state of a job that falls silent
    is shown as well.
    """

    def __init__(self, job: str, order: Sequence[str], keep_lines: int, seconds: float, clock: str):
        self.job, self.order, self.keep_lines = job, list(order), keep_lines
        self.seconds, self.clock = seconds, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)
        self.shown = handle.getValueState("shown", "at double, waiting boolean")

    def handleInputRows(self, key, rows, timerValues):
        state = JobState(self.keep_lines, self.state.get())
        at, waiting = self.shown.get() or (None, False)
        frame = _in_order(rows, self.order)
        by_event = self.clock == "event"
        if by_event:
            times = (frame["ts"] - pd.Timestamp(0)) / pd.Timedelta(seconds=1)
        else:
            times = [timerValues.getCurrentProcessingTimeInMs() / 1000] * len(frame)
        updates, changed = [], False
        for now, event in zip(times, _events(frame), strict=True):
            state.add(*event)
            changed = True
            if event[0] == "Phase" or at is None or now - at > self.seconds:
                updates.append((key[0], now, event[0] == "Phase", *state.values()[:-1], list(state.log)))
                at, changed = now, False
        if changed and not by_event and not waiting:
            self.handle.registerTimer(int((at + self.seconds + _EARLY) * 1000))
            waiting = True
        self.state.update(state.values())
        self.shown.update((at, waiting))
        yield _updates(updates, self.job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = JobState(self.keep_lines, self.state.get())
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        self.shown.update((now, False))
        yield _updates([(key[0], now, False, *state.values())], self.job)

    def close(self) -> None:
        pass


def _updates(rows: list, job: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[job, "at", "phase_changed", *_FIELDS])


def _keyed(events: DataFrame, job: str, order: Sequence[str], more: Sequence[str] = ()) -> tuple:
    """Grouped events without columns the fold doesn't need or rows without a job, and the key's type."""
    wanted = dict.fromkeys([job, *order, *more, "kind", "phase", "bytes", "file", "message"])
    events = events.filter(F.col(job).isNotNull())
    return events.select([c for c in wanted if c in events.columns]).groupBy(job), f"{job} {events.schema[job].dataType.simpleString()}"


def job_states(events: DataFrame, job: str = "job_id", order: Sequence[str] = ("seq",), keep_lines: int = LOG_LINES) -> DataFrame:
    """A stream of PROGRESS_EVENT rows as a stream of states: after each micro-batch, one row per job it touched."""
    grouped, key = _keyed(events, job, order)
    return grouped.transformWithStateInPandas(FoldJobs(job, order, keep_lines), f"{key}, {_STATE}", "Append", "None")


def job_updates(
    events: DataFrame,
    job: str = "job_id",
    order: Sequence[str] = ("ts", "seq"),
    keep_lines: int = LOG_LINES,
    seconds: float = UPDATE_SECONDS,
    clock: str = "event",
) -> DataFrame:
    """A stream of the updates to show, see :class:`ThrottleJobs`; ``at`` is the time of each."""
    grouped, key = _keyed(events, job, order, ["ts"] if clock == "event" else [])
    fold = ThrottleJobs(job, order, keep_lines, seconds, clock)
    mode = "None" if clock == "event" else "ProcessingTime"
    updates = grouped.transformWithStateInPandas(fold, f"{key}, at double, phase_changed boolean, {_STATE}", "Append", mode)
    return updates.withColumn("at", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("bigint")))


def start(rows: DataFrame, folder: str, every: str | None = None, report: Callable[[DataFrame], None] | None = None, keep: bool = True) -> StreamingQuery:
    """Append ``rows`` to ``folder/rows``, each once, also across restarts.

    ``every`` (such as ``"1 second"``) starts a micro-batch that often; without it the stream
    works through what is there and ends. ``report`` is handed each micro-batch's rows before
    they are kept; a micro-batch that is repeated after a failure is handed over again.
    """
    target = f"{folder.rstrip('/')}/rows"

    def out(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            if report and not batch.isEmpty():
                report(batch)
            if keep:  # a repeated micro-batch replaces its own rows
                batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = rows.writeStream.option("checkpointLocation", f"{folder.rstrip('/')}/offsets").outputMode("append")
    writer = writer.foreachBatch(out) if report or keep else writer.format("noop")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    with _keyed_state(rows.sparkSession):
        return writer.start()


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB: Spark's default store can't hold keyed state.

    A stream takes the settings along as it starts, and again from its own offsets, so the session's is put back.
    """
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)


def kept_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`start` has kept so far."""
    return spark.read.parquet(f"{folder.rstrip('/')}/rows").drop("batch")


def progress_stream(
    events: DataFrame,
    folder: str,
    job: str = "job_id",
    order: Sequence[str] = ("seq",),
    keep_lines: int = LOG_LINES,
    every: str | None = None,
    report: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Fold events into job states below ``folder``; :func:`current_state` reads them there."""
    return start(job_states(events, job, order, keep_lines), folder, every, report, keep=False)


def throttled_updates(
    events: DataFrame,
    folder: str,
    job: str = "job_id",
    order: Sequence[str] = ("ts", "seq"),
    seconds: float = UPDATE_SECONDS,
    clock: str = "event",
    every: str | None = None,
    report: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Keep, and hand to ``report``, only the updates worth showing."""
    return start(job_updates(events, job, order, seconds=seconds, clock=clock), folder, every, report)


def current_state(spark: SparkSession, folder: str) -> DataFrame:
    """Phase, file, totals and the log tail of each job, as of the last finished micro-batch.

    Read from the stream's own state: nothing is kept beside it, and the stream may be running.
    """
    store = spark.read.format("statestore").option("path", f"{folder.rstrip('/')}/offsets").option("stateVarName", "job")
    return store.load().select("key.*", "value.*")
