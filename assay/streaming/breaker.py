"""The failure circuit breaker as a live alert, on Spark's own keyed state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from assay.operators.runs import FAILURE_LIMIT
from assay.streaming.progress import kept_rows, start


class FollowRuns(StatefulProcessor):
    """A run's position and open streak; the row it stops at is emitted once, in the micro-batch it happens."""

    def __init__(self, run: str, order: Sequence[str], limit: int, reset_on_skip: bool):
        self.run, self.order, self.limit, self.reset_on_skip = run, list(order), limit, reset_on_skip

    def init(self, handle) -> None:
        self.state = handle.getValueState("run", "n_seen bigint, streak bigint, stopped boolean")

    def handleInputRows(self, key, rows, timerValues):
        seen, streak, stopped = self.state.get() or (0, 0, False)
        if stopped:  # what a stopped run still sends changes nothing
            return
        log = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        at, streak = stop_of(log, streak, self.limit, self.reset_on_skip)
        self.state.update((seen + len(log), streak, at is not None))
        if at is not None:
            yield pd.DataFrame({self.run: [key[0]], "stop_position": [seen + at]})

    def close(self) -> None:
        pass


def stop_of(log: pd.DataFrame, streak: int, limit: int, reset_on_skip: bool) -> tuple[int | None, int]:
    """The 1-based row an ordered log stops at, or None, and the streak open after it; ``streak`` was open before."""
    status = log["status"]
    fails = (status == "FAIL").to_numpy()
    resets = ((status == "OK") | (reset_on_skip & (status == "SKIP"))).to_numpy()
    counted = np.concatenate([[streak], streak + np.cumsum(fails)])
    # failures counted up to the last reset; before any, the open streak goes on
    base = np.maximum.accumulate(np.where(np.concatenate([[False], resets]), counted, 0))
    streaks = (counted - base)[1:]
    trips = fails & (streaks >= limit)
    if "error_class" in log:
        trips |= fails & (log["error_class"] == "DEVICE").to_numpy()
    stops = np.flatnonzero(trips)
    return (int(stops[0]) + 1 if len(stops) else None), int(streaks[-1]) if len(streaks) else streak


def run_stops(log: DataFrame, run: str = "run_id", order: Sequence[str] = ("seq",), limit: int = FAILURE_LIMIT, reset_on_skip: bool = False) -> DataFrame:
    """A stream of log rows as a stream of ``(run, stop_position)``, each run at most once.

    Rows of a run have to arrive in order from micro-batch to micro-batch; within one they
    may be in any order. Rows without a run belong to none.
    """
    wanted = [c for c in dict.fromkeys([run, *order, "status", "error_class"]) if c in log.columns]
    schema = f"{run} {log.schema[run].dataType.simpleString()}, stop_position bigint"
    follow = FollowRuns(run, order, limit, reset_on_skip)
    return log.filter(F.col(run).isNotNull()).select(wanted).groupBy(run).transformWithStateInPandas(follow, schema, "Append", "None")


def stream_breaker(
    log: DataFrame,
    folder: str,
    run: str = "run_id",
    order: Sequence[str] = ("seq",),
    limit: int = FAILURE_LIMIT,
    reset_on_skip: bool = False,
    every: str | None = None,
    alert: Callable[[DataFrame], None] | None = None,
) -> StreamingQuery:
    """Keep the stops below ``folder`` and hand them to ``alert`` as they happen."""
    return start(run_stops(log, run, order, limit, reset_on_skip), folder, every, alert)


def tripped_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that stopped, and where."""
    return kept_rows(spark, folder)
