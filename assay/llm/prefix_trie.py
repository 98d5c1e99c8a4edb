"""Conversation prefix trie from sorted sequences, without building a tree.

Every turn (role, text) becomes a 16-byte digest, a conversation the digests of its turns
in a row. Conversations are range-partitioned and sorted by that; a task has a slice of the
order. Within it the longest common prefix of each conversation with the one before is
known (LCP), and a sparse table answers range minima over the LCPs. A prefix of depth d
first appears at row i if LCP(i) < d; from there two binary searches over the table, one to
the left, one to the right, give the rows that share it: its members. Its parent is where
the left search of depth d - 1 ends. In the order (first row, depth) a subtree is one run,
so sums over subtrees are differences of running sums.

A prefix that reaches an edge of its slice may go on in the next one. Those are the
prefixes of a slice's first and last conversation only; they are added up by the digest
of the prefix, and put in the same order by the edges they span, so the few thousand
of them are finished in one small task. Everything else is final where it was found.

Cases: a NULL role or text is empty. Turns are ordered by number, NULL first; equal numbers
by role, the first 64 characters of the text, then a digest of it. Repeated turns stay. Rows without a conversation id belong to no conversation.
Equal conversations are members of the same nodes, their order is by id. An empty table
gives no rows, not even a root. Other columns of the input are not read. A conversation's
digests (16 bytes a turn) and lengths are held by one task, its texts are not.
"""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.plans.storing import store

HEADS, BASES = 9, 5
DIGEST = 16


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and its ``turns`` in order: digest and UTF-8 length of the text of each."""
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    digest = F.md5(F.concat_ws(":", F.octet_length("role"), "role", "text").cast("binary"))
    tied = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", F.substring("text", 1, 64).alias("head"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(tied)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t.digest.alias("digest"), t.size.alias("size"))).alias("turns"))


def rebuilt(convs: DataFrame, heads: int = HEADS, bases: int = BASES) -> DataFrame:
    """Each conversation with its first turns taken from the first one of its block of ``bases``.

    How many: crc32 of the decimal id, modulo ``heads``.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = convs.filter(F.col("conv_id") % bases == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    joined = convs.withColumn("h", h).join(first, F.col("conv_id") - F.col("conv_id") % bases == F.col("base"), "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def sparse_table(values: np.ndarray, of=np.minimum) -> list[np.ndarray]:
    """Level k has, for each place, the minimum of the 2^k values from there on."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        below, step = levels[-1], 2 ** (len(levels) - 1)
        levels.append(of(below[:-step], below[step:]))
    return levels


def extents(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray, to_left: bool) -> np.ndarray:
    """The outermost row on one side up to which all common prefixes have ``depths`` turns or more."""
    n, at = len(levels[0]), rows.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, level = 2**k, levels[k]
        if to_left:  # LCP(at - step + 1 .. at)
            inside = at - step >= 0
            place = at - step + 1
        else:  # LCP(at + 1 .. at + step)
            inside = at + step <= n - 1
            place = at + 1
        reached = inside & (level[np.where(inside, place, 0)] >= depths)
        at = np.where(reached, at - step if to_left else at + step, at)
    return at


def range_minimum(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), levels[0].dtype)
    for level in np.unique(k):
        mine = k == level
        out[mine] = np.minimum(levels[level][first[mine]], levels[level][last[mine] + 1 - 2**level])
    return out


def common_prefixes(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each sorted sequence with the one before; -1 for the first. ``tokens`` has two 64-bit columns."""
    sizes = np.diff(starts)
    lcp = np.full(len(sizes), -1)
    if len(sizes) < 2:
        return lcp
    both = np.minimum(sizes[1:], sizes[:-1])
    ends = np.cumsum(both)
    place = np.arange(ends[-1]) - np.repeat(ends - both, both)
    differs = (tokens[np.repeat(starts[1:-1], both) + place] != tokens[np.repeat(starts[:-2], both) + place]).any(1)
    padded = np.concatenate([np.where(differs, place, np.iinfo(np.int64).max), [np.iinfo(np.int64).max]])
    first = np.minimum.reduceat(padded, ends - both)
    lcp[1:] = np.where(both > 0, np.minimum(first, both), 0)
    return lcp


_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.string()), ("n_convs", pa.int64())]
_NODE += [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_EDGE = [("key", pa.string()), ("size", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("slice", pa.int64()), ("ends", pa.string())]
_LOCAL = pa.schema(_NODE + _EDGE)
_LOCAL_DDL = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, parent_key string, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, "
    "key string, size bigint, first bigint, last bigint, slice bigint, ends string"
)
_NOTHING = sha256(b"").hexdigest()
#: Ids of members that end at an edge node go on in chunks of so many.
CHUNK = 1 << 16


def _prefix_keys(sequence: bytes, depths: int) -> list[str]:
    running, keys = blake2b(digest_size=16), []
    for d in range(depths + 1):
        keys.append(f"{d}:{running.hexdigest()}")
        running.update(sequence[DIGEST * d : DIGEST * (d + 1)])
    return keys


def slice_nodes(ids: np.ndarray, sequences: list[bytes], sizes: np.ndarray, number: int):
    """Batches with all nodes of a sorted slice; those at its edges carry a key and are partial."""
    n = len(ids)
    lengths = np.array([len(s) for s in sequences]) // DIGEST
    starts = np.concatenate([[0], np.cumsum(lengths)])
    tokens = np.frombuffer(b"".join(sequences), np.uint64).reshape(-1, 2)
    lcp = common_prefixes(tokens, starts)
    levels, names = sparse_table(lcp), sparse_table(ids)
    new = lengths - lcp
    base = np.concatenate([[0], np.cumsum(new)])
    row = np.repeat(np.arange(n), new)
    depth = np.arange(base[-1]) - np.repeat(base[:-1], new) + lcp[row] + 1
    last = extents(levels, row, depth, to_left=False)
    members = last - row + 1
    inner = depth > 0
    parent = np.full(len(row), -1)
    up = extents(levels, row[inner], depth[inner] - 1, to_left=True)
    parent[inner] = base[up] + depth[inner] - 2 - lcp[up]
    smallest = range_minimum(names, row, last)
    size = np.zeros(len(row), np.int64)
    size[inner] = sizes[starts[row[inner]] + depth[inner] - 1]
    edge = (row == 0) | (last == n - 1)
    done = ~edge
    children = np.bincount(parent[done & inner], minlength=len(row))
    saved = np.where(done, (members - 1) * size, 0)
    leaf = done & (children == 0)
    through = base[last + 1]

    def below(values):
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[through] - sums[np.arange(len(row))]

    saved, leaves = below(saved), below(leaf)
    # members that end here stand first, by id; equal sequences follow each other
    same = np.concatenate([(lcp[1:] < lengths[:-1]) | (lengths[1:] != lengths[:-1]), [True]])
    stops = np.flatnonzero(same)
    ended = np.where(depth == lengths[row], stops[np.searchsorted(stops, row)] - row + 1, 0)
    keys = dict(enumerate(_prefix_keys(sequences[0], int(lengths[0]))))
    keys_last = _prefix_keys(sequences[-1], int(lengths[-1]))

    def key_of(node):
        return keys[int(depth[node])] if row[node] == 0 else keys_last[int(depth[node])]

    texts = list(map(str, ids.tolist()))
    for low in range(0, len(row), 1 << 16):
        some = np.arange(low, min(low + (1 << 16), len(row)))
        above = parent[some]
        known = (above >= 0) & done[above]
        columns = {
            "conv_id": smallest[some], "depth": depth[some], "n_convs": members[some], "n_children": children[some], "n_leaves": leaves[some], "saved_tokens": saved[some],
            "parent_conv_id": pa.array(np.where(known, smallest[above], 0), mask=~known),
            "parent_key": [key_of(p) if p >= 0 and edge[p] else None for p in above],
            "ends_sha256": [_NOTHING if not ended[i] else sha256(",".join(texts[row[i] : row[i] + ended[i]]).encode()).hexdigest() if done[i] else None for i in some],
            "key": [key_of(i) if edge[i] else None for i in some],
            "size": size[some],
            "first": np.where(row[some] == 0, 2 * number, 2 * number + 1), "last": np.where(last[some] == n - 1, 2 * number + 1, 2 * number),
            "slice": np.full(len(some), number), "ends": pa.nulls(len(some), pa.string()),
        }
        yield pa.RecordBatch.from_pydict(columns, _LOCAL)
    for i in np.flatnonzero(edge & (ended > 0)):
        for chunk in range(int(row[i]), int(row[i] + ended[i]), CHUNK):
            part = ",".join(texts[chunk : min(chunk + CHUNK, int(row[i] + ended[i]))])
            yield pa.RecordBatch.from_pylist([{"key": key_of(i), "slice": number, "first": chunk, "ends": part}], _LOCAL)


def _slices(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.concat_batches(held)
        sizes = table.column("sizes").flatten().to_numpy()
        yield from slice_nodes(table.column("conv_id").to_numpy(), table.column("sequence").to_pylist(), sizes, TaskContext.get().partitionId())


def _digests(batches):
    """Chunks of ids come by key and in order: their digest, without holding more than a chunk."""
    key, running = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [running.hexdigest()]})
                key, running = row["key"], sha256()
            else:
                running.update(b",")
            running.update(row["ends"].encode())
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [running.hexdigest()]})


_EDGES = "key string, parent_key string, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _edges(batches):
    """All edge nodes, added up by key: their own shares and those of the edge nodes below."""
    table = pa.concat_batches(list(batches) or [pa.RecordBatch.from_pylist([], pa.schema([]))])
    if not table.num_rows:
        return
    table = table.sort_by([("first", "ascending"), ("depth", "ascending")])
    first, last = table["first"].to_numpy(), table["last"].to_numpy()
    at = {key: i for i, key in enumerate(table["key"].to_pylist())}
    parent = np.array([at.get(k, -1) for k in table["parent_key"].to_pylist()])
    children = table["n_children"].to_numpy() + np.bincount(parent[parent >= 0], minlength=len(parent))
    members = table["n_convs"].to_numpy()
    through = np.searchsorted(first, last, side="right")

    def below(own):
        sums = np.concatenate([[0], np.cumsum(own)])
        return sums[through] - sums[np.arange(len(own))]

    # partial sums of a node hold all finished nodes below it: only edge nodes are still to be added
    saved = table["saved_tokens"].to_numpy() + below((members - 1) * table["size"].to_numpy())
    leaves = table["n_leaves"].to_numpy() + below((children == 0).astype(np.int64))
    columns = [table["key"], table["parent_key"], table["conv_id"], table["depth"], table["n_convs"], children, leaves, saved]
    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], [c.split()[0] for c in _EDGES.split(", ")])


def trie(convs: DataFrame) -> DataFrame:
    """All nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``convs`` has ``conv_id`` (each once) and ``turns``, see :func:`conversations`.
    """
    sequence = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    rows = convs.select("conv_id", sequence.alias("sequence"), F.transform("turns", lambda t: t.size).alias("sizes"))
    ordered = rows.repartitionByRange("sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    local, _ = store(ordered.mapInArrow(_slices, _LOCAL_DDL), "trie-slices")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parts = local.filter("key IS NOT NULL AND ends IS NULL").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.max("size").alias("size"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    edges, _ = store(parts.coalesce(1).mapInArrow(_edges, _EDGES), "trie-edges")
    chunks = local.filter("ends IS NOT NULL").select("key", "slice", "first", "ends")
    ends = chunks.repartition("key").sortWithinPartitions("key", "slice", "first").select("key", "ends").mapInArrow(_digests, "key string, ends_sha256 string")
    above = edges.select(F.col("key").alias("above"), F.col("conv_id").alias("above_id"))
    finished = local.filter("key IS NULL").join(above, F.col("parent_key") == F.col("above"), "left")
    finished = finished.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id")).select(names)
    outer = edges.join(ends, "key", "left").join(above, F.col("parent_key") == F.col("above"), "left")
    outer = outer.select("conv_id", "depth", F.col("above_id").alias("parent_conv_id"), *names[3:-1], F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    return finished.unionByName(outer)
