"""SimHash near-duplicates: 64-bit fingerprints linked at two differing bits or fewer.

Pairs are found by a self-join of binary tries. Two fingerprints that differ in at most
two bits agree in at least six of their eight bytes, so each is entered into 28 tries, one
for each choice of six bytes, which come first in its bit order. The shuffle walks the
first 48 levels, on which a pair must agree: it brings together the fingerprints below
one node. The last 16 levels are walked in the task, node pairs together, adding up the
differing bits and leaving a pair of nodes as soon as it has more than two. Below such a
node there are at most 2^16 distinct fingerprints, whatever the input: equal
fingerprints, however many documents have them, are one class before the join.

Cases: NULL, empty and blank texts have no words and the fingerprint zero, which links
like any other. Documents with the same text share a fingerprint and a component.
Repeated rows are answered one by one. A NULL id never becomes a component's id unless
all its documents have none. Texts are hashed whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from assay.llm.common import components, free_name, local_roots
from assay.plans.storing import store

SEED = 42
MAX_BITS = 2
_AGREEING = list(combinations(range(8), 6))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 16


def shingles(text: str, size: int = 3) -> list[bytes]:
    """Runs of ``size`` words in order, repeats included; all words if there are fewer; none without words."""
    words = text.encode().translate(_LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def simhash(text: str | None, size: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    parts = shingles(text or "", size)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(parts), _BLOCK):
        hashes = np.array([xxh64_intdigest(part, SEED) for part in parts[start : start + _BLOCK]], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(parts), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(t) for t in batch], dtype="int64")


def as_hex(bits: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def close_pairs(codes: np.ndarray, first: np.ndarray, last: np.ndarray, max_bits: int = MAX_BITS, levels: int = 16):
    """Index pairs of ``codes`` that differ in at most ``max_bits`` bits, within the ranges [first, last).

    Codes are sorted and distinct within a range, so a node of a range's trie is a range
    too. All tries are walked together, a level at a time.
    """
    a0, a1, b0, b1 = first, last, first, last
    apart = np.zeros(len(first), np.int8)
    for level in range(levels - 1, -1, -1):
        ones = np.concatenate([[0], np.cumsum((codes >> level) & 1)])
        a, b = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # where the ones begin
        same = (a0 == b0) & (a1 == b1)
        steps = [(a0, a, b0, b, apart, True), (a, a1, b, b1, apart, True), (a0, a, b, b1, apart + 1, True), (a, a1, b0, b, apart + 1, ~same)]
        kept = []
        for x0, x1, y0, y1, bits, wanted in steps:
            single = (x0 == y0) & (x1 == y1) & (x1 - x0 < 2)  # a lone fingerprint with itself
            good = (x1 > x0) & (y1 > y0) & (bits <= max_bits) & ~single & wanted
            kept.append([x[good] for x in (x0, x1, y0, y1, bits)])
        a0, a1, b0, b1, apart = (np.concatenate(x) for x in zip(*kept, strict=True))
    return a0, b0


def _walk(batches):
    places = [[8 * b for b in range(8) if b not in agree] for agree in _AGREEING]
    places = np.array(places, np.uint64)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("members"))
        sizes = np.diff(lists.offsets.to_numpy())
        members = lists.flatten().to_numpy().view(np.uint64)
        trie = np.repeat(np.arange(len(sizes)), sizes)
        low, high = places[batch.column(batch.schema.get_field_index("trie")).to_numpy()[trie]].T
        codes = (((members >> low) & np.uint64(255)) | (((members >> high) & np.uint64(255)) << np.uint64(8))).astype(np.int64)
        order = np.lexsort((codes, trie))
        ends = np.cumsum(sizes)
        left, right = close_pairs(codes[order], ends - sizes, ends)
        root = local_roots(len(members), left, right)
        joined = np.flatnonzero(root != np.arange(len(root)))
        found = members[order].view(np.int64)
        yield pa.RecordBatch.from_pydict({"a": pa.array(found[joined]), "b": pa.array(found[root[joined]])})


def links(fingerprints: DataFrame, column: str = "bits") -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that have the same components as all pairs within ``MAX_BITS``."""
    bits = F.col(column)
    masks = [sum(0xFF << (8 * b) for b in agree) for agree in _AGREEING]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tries = F.array(*[F.struct(F.lit(i).alias("trie"), bits.bitwiseAND(F.lit(m)).alias("node")) for i, m in enumerate(signed)])
    below = (
        fingerprints.select(bits, F.explode(tries).alias("t"))
        .groupBy("t.trie", "t.node")
        .agg(F.collect_list(column).alias("members"))
        .filter(F.size("members") > 1)
    )
    return below.select("trie", "members").mapInArrow(_walk, "a bigint, b bigint")


def _groups(rows: DataFrame) -> DataFrame:
    """(bits, component, component_id) of all fingerprints of ``rows`` (doc_id, bits)."""
    classes, _ = store(rows.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    reached = components(links(classes), "a", "b")
    grouped = (
        classes.join(reached, classes.bits == reached.node, "left")
        .select("bits", "first_id", F.coalesce("component", "bits").alias("component"))
    )
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return grouped.join(smallest, "component").select("bits", "component", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the smallest id reachable over links."""
    rows, _ = store(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("bits")), "simhash")
    return rows.join(_groups(rows), "bits").select("doc_id", as_hex("bits").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id, NULL last, then the smallest digest of its text.

    Rows are judged one by one, each by its own fingerprint, whatever ids they share. Rows
    equal in both id and text are copies of each other, of which the first is taken. Ids, fingerprints and
    digests alone are stored: texts are read again, not written a second time.
    """
    key, row = free_name("_key", docs), free_name("_row", docs)
    digest = F.sha2(F.col(text).cast("binary"), 256)
    own = F.concat_ws(":", F.coalesce(digest, F.lit("-")), F.col(doc_id).cast("string"))  # without a colon if the id is NULL
    rows, _ = store(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("bits"), F.md5(F.col(text).cast("binary")).alias("digest"), own.alias("key")), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "key")
    chosen = rows.join(_groups(rows), "bits").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    copies = rows.groupBy("key").agg(F.count("*").alias("n"))
    chosen, _ = store(chosen.join(copies, "key").withColumnRenamed("key", key), "simhash-chosen")
    keyed = docs.withColumn(key, own)
    alone = keyed.join(chosen.filter("n = 1"), key, "left_semi").select(docs.columns)
    if chosen.filter("n > 1").isEmpty():
        return alone
    # many copies of one row are first reduced where they are read
    first = F.min_by(F.struct(*docs.columns), row).alias("first"), F.min(row).alias(row)
    repeated = keyed.withColumn(row, F.monotonically_increasing_id()).join(chosen.filter("n > 1"), key, "left_semi")
    repeated = repeated.groupBy(key, F.pmod(row, F.lit(32)).alias("share")).agg(*first)
    return alone.unionByName(repeated.groupBy(key).agg(F.min_by("first", row).alias("first")).select("first.*"))
