"""Running aggregates over ordered groups of any size.

A plain window hands each group to one task, which fails when one run or job owns a
third of the log. Here an oversized group is cut into consecutive slices: each slice is
windowed by its own task, the slice totals are scanned in turn, and what came before is
added back. Small inputs keep the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.plans.sizing import ONE_TASK_ROWS, broadcast_if_small, oversized_rows
from assay.plans.storing import store

SLICE = "_slice"


def slice_groups(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    rows_per_task: int = ONE_TASK_ROWS,
) -> DataFrame:
    """``df`` itself when every group fits a task, else ``df`` with a slice number.

    The slice number grows with ``order``, which must be unique within a group. The rows
    are range-partitioned on (group, order), which splits a big group like any other
    range, and written out: range bounds come from sampling, so they have to be fixed
    before the slices are read twice.
    """
    n_rows = oversized_rows(df, groups, rows_per_task)
    if n_rows is None:
        return df
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(width, -(-n_rows // rows_per_task))
    sliced = df.repartitionByRange(parts, *groups, *order).withColumn(SLICE, F.spark_partition_id())
    return store(sliced, "slices")[0]


def running(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    last: Mapping[str, Column] | None = None,
    sums_at: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running aggregates up to and including each row of :func:`slice_groups`' result.

    ``sums``: running totals of non-negative values. ``last``: the last non-null value.
    ``sums_at``: ``name: (sum, condition)``, what that total was at the last row where the
    condition held. All of them share one shuffle and one sort.
    """
    last, sums_at = last or {}, sums_at or {}
    keys = [*groups, SLICE] if SLICE in df.columns else [*groups]
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns(
        {name: F.sum(value).over(so_far) for name, value in sums.items()}
        | {name: F.last(value, ignorenulls=True).over(so_far) for name, value in last.items()}
    )
    # A total never falls, so its largest value where the condition held is the latest one.
    if sums_at:
        out = out.withColumns(
            {name: F.max(F.when(held, F.col(total))).over(so_far) for name, (total, held) in sums_at.items()}
        )
    if SLICE not in df.columns:
        return out
    return _add_what_came_before(out, groups, order, [*sums], [*last], {n: total for n, (total, _) in sums_at.items()})


def _add_what_came_before(
    out: DataFrame, groups: Sequence[str], order: Sequence[str], sums: list, last: list, sums_at: dict
) -> DataFrame:
    keys, here = [*groups, SLICE], F.struct(*order)
    names = [*sums, *last, *sums_at]
    ends = out.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in sums],
        *[F.max_by(name, F.when(F.col(name).isNotNull(), here)).alias(name) for name in last],
        *[F.max(name).alias(name) for name in sums_at],
    )
    earlier = Window.partitionBy(*groups).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({f"_{name}": F.coalesce(F.sum(name).over(earlier), F.lit(0)) for name in sums})
    carried = carried.withColumns(
        {f"_{name}": F.last(name, ignorenulls=True).over(earlier) for name in last}
        | {f"_{name}": F.max(F.col(name) + F.col(f"_{total}")).over(earlier) for name, total in sums_at.items()}
    ).select(*keys, *[f"_{name}" for name in names])
    joined = out.join(broadcast_if_small(carried), keys)
    return joined.withColumns(
        {name: F.col(name) + F.col(f"_{name}") for name in sums}
        | {name: F.coalesce(name, f"_{name}") for name in last}
        | {
            name: F.coalesce(F.col(name) + F.col(f"_{total}"), F.col(f"_{name}"))
            for name, total in sums_at.items()
        }
    ).drop(*[f"_{name}" for name in names])
