"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosine.

Vectors are scaled to length one; a cosine of 0.95 is then a distance of 0.316. A hash is
a Gaussian projection plus an offset, cut into steps of ``WIDTH``; ``HASHES`` of them make
a table's bucket, and there are ``TABLES`` tables. At the limit a pair shares a hash with
probability 0.874 and a table with 0.068, hence one of 64 tables with 0.989; at cosine 0.96
with 0.998. Unrelated vectors share a table with probability 5e-7, so candidates stay few.

Equal vectors are one class before hashing. Buckets with two classes or more are compared
in blocks of matrix products; a bucket of more than ``BLOCK`` classes is split by a hash of
the id into parts, and each pair of parts is a group of its own. Nothing is left out, and a
block returns counts and a spanning forest, never all of its pairs. A pair that meets
in several tables is counted in the first.

Cases: vectors that are NULL, empty, zero, or hold NULL or non-finite numbers link with
nothing. Vectors of different lengths don't link. Repeated rows are vectors of their own.
A row with a NULL id counts as a linked vector; its id can't name a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import components, local_roots
from assay.plans.storing import store

COSINE = 0.95
TABLES, HASHES, WIDTH = 64, 20, 2.0
BLOCK = 512
_SEED = 20240229


def _signatures(unit: np.ndarray) -> np.ndarray:
    """A 64-bit bucket number per vector (row) and table."""
    drawn = np.random.default_rng([_SEED, unit.shape[1]])
    directions = drawn.standard_normal((unit.shape[1], TABLES * HASHES))
    offsets = drawn.uniform(0, WIDTH, TABLES * HASHES)
    mixers = drawn.integers(1, 2**63, (TABLES, HASHES), dtype=np.uint64) | np.uint64(1)
    steps = np.floor((unit @ directions + offsets) / WIDTH).astype(np.int64).view(np.uint64)
    return (steps.reshape(len(unit), TABLES, HASHES) * mixers).sum(2, dtype=np.uint64).view(np.int64)


def _unit(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # no overflow in the squares
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _hashed(batches):
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        for size in np.unique(sizes):
            rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
            for start in range(0, rows.num_rows, 512):
                part = rows.slice(start, 512)
                signs = _signatures(_unit(part.column(1)))
                n = part.num_rows
                yield pa.RecordBatch.from_pydict(
                    {
                        "rep": part.column(0).take(pa.array(np.repeat(np.arange(n), TABLES))),
                        "lsh": pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)),
                        "bucket": pa.array(signs.reshape(-1) + size),
                    }
                )


def _compared(batches):
    """Groups (lsh, bucket, low, high) come in sorted order; one may lie across batches."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        keys = [held.column(i).to_numpy() for i in range(4)]
        new = np.concatenate([[True], np.any([np.diff(k) != 0 for k in keys], axis=0)]) if held.num_rows else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        yield from _blocks(held, starts)
        held = held.slice(starts[-1]) if len(starts) else None
    if held is not None and held.num_rows:
        yield from _blocks(held, np.array([0, held.num_rows]))


def _blocks(rows, starts):
    for first, last in zip(starts[:-1], starts[1:], strict=True):
        group = rows.slice(first, last - first)
        if group.num_rows > 1:
            yield from _block(group)


def _block(group):
    table, low, high = (group.column(i)[0].as_py() for i in (0, 2, 3))
    part = group.column(4).to_numpy()
    copies = group.column(6).to_numpy()
    unit = _unit(group.column(7))
    left = np.flatnonzero(part == low)
    right = left if low == high else np.flatnonzero(part == high)
    if not len(left) or not len(right):
        return
    i, j = np.nonzero(unit[left] @ unit[right].T >= COSINE)
    i, j = left[i], right[j]
    if low == high:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        signs = _signatures(unit)[:, :table]
        met = np.concatenate([(signs[i[s : s + 65536]] == signs[j[s : s + 65536]]).any(1) for s in range(0, len(i), 65536)])
        i, j = i[~met], j[~met]
    if not len(i):
        return
    links = np.bincount(i, copies[j], len(part)) + np.bincount(j, copies[i], len(part))
    used = np.flatnonzero(links)
    root = local_roots(len(part), i, j)[used]
    reps = group.column(5)
    yield pa.RecordBatch.from_pydict(
        {"rep": reps.take(pa.array(used)), "root": reps.take(pa.array(root)), "links": pa.array(links[used].astype(np.int64))}
    )


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept``: one row per row of ``vectors``."""
    value = F.col("embedding")
    usable = (
        value.isNotNull()
        & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(value, lambda x: x != 0)
    )
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).withColumn(
        # + 0.0: a negative zero is a zero
        "digest", F.when(F.coalesce(usable, F.lit(False)), F.md5(F.to_json(F.transform(value, lambda x: x + F.lit(0.0)))))
    )
    rows, _ = store(rows, "vectors")
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("rep_id"), F.first("embedding").alias("embedding")
    )
    classes, _ = store(classes.select(F.md5("digest").alias("rep"), "*"), "vector-classes")
    signed = classes.select("rep", "embedding", F.size("embedding").alias("size")).mapInArrow(_hashed, "rep string, lsh int, bucket bigint")
    signed, _ = store(signed, "vector-buckets")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    shared = signed.groupBy("lsh", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    dealt = (
        signed.join(shared, ["lsh", "bucket"])
        .select("lsh", "bucket", "rep", own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("lsh", "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "rep")
    )
    key = ["lsh", "bucket", "low", "high"]
    grouped = dealt.join(classes.select("rep", "copies", "embedding"), "rep").select(*key, "part", "rep", "copies", "embedding")
    found = grouped.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compared, "rep string, root string, links bigint")
    found, _ = store(found, "vector-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.select("rep", "root"), "rep", "root")
    named = (
        classes.join(linked, "rep", "left")
        .join(reached, F.col("rep") == F.col("node"), "left")
        .select("digest", "rep_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    smallest = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    answers = named.join(smallest, "component").select("digest", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "digest").join(answers, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
