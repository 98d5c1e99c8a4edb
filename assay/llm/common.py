"""Helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import scratch_dir

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from; a NULL id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0)) == 0


def use_checkpoints(spark: SparkSession) -> None:
    """``checkpoint()`` writes to the cluster's ``spark.checkpoint.dir``; a local session without one gets its own."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch_dir(spark, "llm"))


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Smaller Arrow batches: with thousands of texts in a batch the defaults fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def in_pieces(texts: Iterable[str], size: int, overlap: int = 0) -> Iterator[list[tuple[int, str, int, bool]]]:
    """Lists of (number of the text, piece, leading characters that are context only, whether the text ends).

    A list holds about ``size`` characters whatever the texts' lengths: short texts are
    put together, long ones cut, each cut repeating ``overlap`` characters.
    """
    held, room = [], size
    for number, text in enumerate(texts):
        for start in range(0, len(text) or 1, size):
            lead = min(start, overlap)
            piece = text[start - lead : start + size]
            held.append((number, piece, lead, start + size >= len(text)))
            room -= len(piece) + 1
            if room <= 0:
                yield held
                held, room = [], size
    if held:
        yield held


def free_name(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores behind it until no column of the frames has that name."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the edges (left, right)."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            return root
    return root


def components(edges: DataFrame, left: str, right: str, max_rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Large-star and small-star steps in turn until nothing changes. Every step keeps at
    most one edge per edge it gets, hooks nodes to smaller ones, and is an aggregation
    and a join on the node, so that a node with many edges is split like any skewed key.
    """
    use_checkpoints(edges.sparkSession)
    u, v = F.col("u"), F.col("v")
    star = (
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(u > v)
        .distinct()
        .checkpoint()
    )
    seen, rounds = None, 0
    while True:
        both = star.unionByName(star.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        star = both.join(low, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).filter(u > v).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        hooked = star.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e"))
        star = hooked.select("e.u", "e.v").filter(u > v).distinct().checkpoint()
        state = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rounds += 1
        if state == seen or rounds == max_rounds:
            break
        seen = state
    return star.select(u.alias("node"), v.alias("component")).unionByName(
        star.select(v.alias("node"), v.alias("component")).distinct()
    )
