"""Checks of how big a side is before a plan leans on it being small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: A side is broadcast only below this many estimated bytes.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

#: An ordered group is left to one task only below this many estimated bytes ...
ONE_TASK_BYTES = 64 * 1024 * 1024
#: ... or this many counted rows.
ONE_TASK_ROWS = 5_000_000


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, an upper bound for scans and filters; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when it is known to fit, else leave the join to shuffle."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def oversized_rows(df: DataFrame, groups: Sequence[str], max_rows: int = ONE_TASK_ROWS) -> int | None:
    """The row count of ``df`` if some group is too big for a single task, else None.

    The estimate answers for small inputs at no cost; otherwise the group keys are
    counted, which is one map-side-combined aggregate over those columns alone.
    """
    if max_rows >= ONE_TASK_ROWS and estimated_bytes(df) <= ONE_TASK_BYTES:
        return None
    counts = df.groupBy(*groups).count() if groups else df.agg(F.count("*").alias("count"))
    load = counts.agg(F.max("count").alias("largest"), F.sum("count").alias("total")).first()
    return load.total if (load.largest or 0) > max_rows else None
