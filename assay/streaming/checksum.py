"""A manifest that grows as entries arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from assay.operators.manifests import digest_entries


def _first_of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.drop_duplicates("path")


def stream_checksum(
    entries: DataFrame, target: str, digest: str = "md5", payload: str = "payload", every: str | None = None
) -> StreamingQuery:
    """Append ``(path, size, digest)`` of arriving entries to ``target``, once per path.

    Only digests are shuffled to the state store, and repeats within an Arrow batch are
    dropped before, so a path sent over and over does not load one task.
    """
    rows = digest_entries(entries.filter(f"{payload} IS NOT NULL"), digest, payload)
    thinned = rows.mapInPandas(_first_of_batch, rows.schema)
    writer = (
        thinned.dropDuplicates(["path"])
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", f"{target.rstrip('/')}.offsets")
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
