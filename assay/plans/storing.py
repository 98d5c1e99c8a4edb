"""Tables written once and read many times."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from assay.session import scratch_dir, shared_dir


def store(df: DataFrame, label: str, codec: str | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` below the shared scratch folder; the stored table and its metrics.

    For work that must not be repeated (side effects, digests of files, sampled bounds)
    and for inputs of several later steps. The metrics are aggregates taken while
    writing, so they cost no pass of their own. What is stored survives lost executors.
    """
    place = scratch_dir(df.sparkSession, label)
    schema, seen = df.schema, Observation()
    if metrics:
        df = df.observe(seen, *[value.alias(name) for name, value in metrics.items()])
    (df.write.option("compression", codec) if codec else df.write).parquet(place)
    return df.sparkSession.read.schema(schema).parquet(place), seen.get if metrics else {}


def store_parts(parts: Iterable[DataFrame], label: str, codec: str | None = None) -> DataFrame:
    """One stored table of all ``parts``, made one after another: the shuffle files of one are released before the next is asked for."""
    place = None
    for part in parts:
        place = place or scratch_dir(part.sparkSession, label)
        writer = part.write.mode("append")
        (writer.option("compression", codec) if codec else writer).parquet(place)
        spark, schema = part.sparkSession, part.schema
        release(spark)
    return spark.read.schema(schema).parquet(place)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished queries go.

    Spark removes them once the driver has collected their plans as garbage, which a quiet
    driver may not do for half an hour.
    """
    for _ in range(2):  # the plan of the query that ran last is garbage only from the second time on
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, see :func:`release` too; what depends on them has to be stored itself."""
    for table in tables:
        files = table.inputFiles()
        place = files[0].rpartition("/")[0] if files else ""
        # only folders that scratch_dir made
        if place.rstrip("/").removeprefix("file:").lstrip("/").startswith(shared_dir(table.sparkSession, "").removeprefix("file:").lstrip("/")):
            path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for table in tables[:1]:
        release(table.sparkSession)
