"""Counters, waits and progress ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INT64_MAX = 2**63 - 1
BACKOFF_DOUBLINGS = 5


def backoff_seconds(attempt: Column) -> Column:
    """1, 2, 4, 8, 16, 32, 32, ..."""
    step = F.greatest(F.least(attempt - 1, F.lit(BACKOFF_DOUBLINGS)), F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), step)


def cumulative_backoff(attempt: Column) -> Column:
    """Sum of the first ``attempt`` waits, in closed form: no window is needed."""
    doubling = F.least(attempt, F.lit(BACKOFF_DOUBLINGS + 1)).cast("int")
    flat = F.greatest(attempt - (BACKOFF_DOUBLINGS + 1), F.lit(0)).cast("bigint")
    ramp = F.call_function("shiftleft", F.lit(1).cast("bigint"), doubling) - 1
    return ramp + flat * (1 << BACKOFF_DOUBLINGS)


def saturating_add(left: Column, right: Column) -> Column:
    """Sum of two non-negative sizes, held at the largest BIGINT."""
    return F.coalesce(F.try_add(left, right), F.when(left.isNotNull() & right.isNotNull(), F.lit(INT64_MAX)))


def doubled_work(size: Column) -> Column:
    """A written byte is also read back once."""
    return saturating_add(size, size)


def progress_fraction(completed: Column, total: Column) -> Column:
    """completed / total within 0..1; 0 while the total is unknown."""
    ratio = completed.cast("double") / F.nullif(total, F.lit(0)).cast("double")
    return F.coalesce(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def progress_permille(completed: Column, total: Column) -> Column:
    """Integer thousandths, 0 while the total is unknown."""
    held = F.least(F.greatest(completed, F.lit(0)), total).cast("decimal(38,0)")
    thousandths = F.floor(held * 1000 / total.cast("decimal(38,0)")).cast("bigint")
    return F.when(total > 0, thousandths).otherwise(F.lit(0).cast("bigint"))
