"""Exact top-k search by inner product with two cover trees walked together.

Vectors are dealt to groups of near ones. Every group gets a cover tree: a node's children
are centres picked farthest first until all its points are within half its radius (or
``CHILDREN`` are picked; the radius kept is the true one). Queries get a tree of their own.
A pair of nodes can't hold a product above

    centre · centre + radius_q |centre_x| + radius_x |centre_q| + radius_q radius_x

so it is left out when that is below the worst k-th score within the query node; otherwise
the wider node is split, and two leaves are compared by one matrix product.

First every group searches itself for the queries it holds. With the k-th scores from
there, blocks of queries go through the other groups, which return only what can still be
among the best. What a task holds is one group and one block of queries.

Cases: vectors that are NULL or hold NULL or non-finite components take no part. Vectors
of different lengths are compared as if the shorter one went on with zeros; an empty one
scores 0. Repeated rows are rows of their own: a query is compared with every row but its
own, an equal one included. Equal scores go by the smaller id, NULL ids last, then by any
order. Products beyond 64 bits are given as the largest or smallest long. A query that is
alone has no rows. An empty table gives no rows. Only the two columns named are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.plans.storing import store

K = 10
STEPS = 1024
#: Rows that place the groups, by a hash of their id; they decide where vectors go, not what is found.
PIVOTS = 256
LEAF, QUERY_LEAF, CHILDREN = 96, 16, 64
GROUP_BYTES, GROUP_ROWS = 16 << 20, 1024
#: Groups whose queries make a block.
HOMES = 16
_LONG = 2**63 - 1


class Node(NamedTuple):
    members: np.ndarray
    centre: int
    radius: float
    children: list


def _distances(points: np.ndarray, squares: np.ndarray, members: np.ndarray, centre: int) -> np.ndarray:
    apart = squares[members] + squares[centre] - 2 * (points[members] @ points[centre])
    # what rounding may take away is added: radii may be too large, never too small
    return np.sqrt(np.maximum(apart, 0) + 1e-12 * (squares[members] + squares[centre]))


def cover_tree(points: np.ndarray, leaf: int) -> Node:
    """The tree over all rows of ``points``; a node's own centre is its first child's."""
    squares = np.einsum("ij,ij->i", points, points)
    everything = np.arange(len(points))
    away = _distances(points, squares, everything, 0)
    root = Node(everything, 0, float(away.max()), [])
    open_nodes = [(root, away)]
    while open_nodes:
        node, away = open_nodes.pop()
        if len(node.members) <= leaf or not (points[node.members] != points[node.centre]).any():
            continue
        centres, nearest, owner = [node.centre], away.copy(), np.zeros(len(away), np.int64)
        while len(centres) < CHILDREN and nearest.max() > node.radius / 2:
            far = int(node.members[nearest.argmax()])
            to_far = _distances(points, squares, node.members, far)
            closer = to_far < nearest
            owner[closer] = len(centres)
            nearest[closer] = to_far[closer]
            centres.append(far)
        if np.bincount(owner).max() == len(owner):  # rounding: nothing more to tell apart
            continue
        for number, centre in enumerate(centres):
            mine = owner == number
            if mine.any():
                child = Node(node.members[mine], centre, float(nearest[mine].max()), [])
                node.children.append(child)
                open_nodes.append((child, nearest[mine]))
    return root


class Best:
    """The best ``k`` rows of each query so far, in order."""

    def __init__(self, queries: int, k: int, kind, floor=None):
        self.k = k
        self.scores = np.full((queries, k), -np.inf).astype(kind)
        self.ids = np.full((queries, k), _LONG)
        self.rows = np.full((queries, k), -1)
        #: a score that some other group already has ``k`` times
        self.floor = np.full(queries, -np.inf).astype(kind) if floor is None else floor.astype(kind)

    def worst(self, queries: np.ndarray):
        return np.maximum(self.scores[queries, -1], self.floor[queries])

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = np.concatenate([self.scores[query], scores])
        ids, rows = np.concatenate([self.ids[query], ids]), np.concatenate([self.rows[query], rows])
        if len(scores) > 8 * self.k and scores.dtype != object:  # a bound for those that may stay, ties included
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids, rows = scores[near], ids[near], rows[near]
        order = np.lexsort((rows < 0, ids, -scores))[: self.k]
        self.scores[query], self.ids[query], self.rows[query] = scores[order], ids[order], rows[order]


class Points(NamedTuple):
    """Whole numbers as floats where products are exact, else as Python numbers; ids and row numbers."""

    exact: np.ndarray
    near: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    tree: Node


def indexed(values: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int, exact_in_floats: bool) -> Points:
    near = values.astype(np.float64)
    exact = near if exact_in_floats else values.astype(object)
    return Points(exact, near, np.sqrt(np.einsum("ij,ij->i", near, near)), ids, rows, cover_tree(near, leaf))


def search(queries: Points, data: Points, best: Best) -> None:
    """Improve ``best`` by the rows of ``data``, leaving out pairs of nodes that can't."""

    def bounds(node: Node, others: list[Node], centres: Points, across: Points) -> np.ndarray:
        at = np.array([o.centre for o in others])
        radii = np.array([o.radius for o in others])
        length, lengths = centres.lengths[node.centre], across.lengths[at]
        slack = 1e-9 * (length + node.radius) * (lengths + radii) + 1e-6
        return across.near[at] @ centres.near[node.centre] + node.radius * lengths + radii * length + node.radius * radii + slack

    first = bounds(queries.tree, [data.tree], queries, data)[0]
    waiting = [(first, queries.tree, data.tree)]
    while waiting:
        bound, q, x = waiting.pop()
        worst = best.worst(q.members)
        if bound < worst.min():
            continue
        if not q.children and not x.children:
            _compare(queries, data, q.members, x.members, worst, best)
        elif q.children and (not x.children or q.radius >= x.radius):
            # the nearest pair last, so that it is taken first
            found = bounds(x, q.children, data, queries)
            waiting += [(found[n], q.children[n], x) for n in np.argsort(found)]
        else:
            found = bounds(q, x.children, queries, data)
            waiting += [(found[n], q, x.children[n]) for n in np.argsort(found)]


def _compare(queries: Points, data: Points, q: np.ndarray, x: np.ndarray, worst: np.ndarray, best: Best) -> None:
    for start in range(0, len(x), 4096):  # a leaf of equal vectors may be large
        some = x[start : start + 4096]
        scores = queries.exact[q] @ data.exact[some].T
        scores[queries.rows[q][:, None] == data.rows[some][None, :]] = -np.inf
        good = scores >= worst[:, None]
        good &= scores != -np.inf
        for n in np.flatnonzero(good.any(1)):
            chosen = some[good[n]]
            best.add(int(q[n]), scores[n, good[n]], data.ids[chosen], data.rows[chosen])


def stepped(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", steps: int = STEPS) -> DataFrame:
    """``vec_id`` and ``vector``, each component as a whole number of steps, rounded down; usable vectors only."""
    value = F.col("vector")
    unusable = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    rows = rows.filter(value.isNotNull() & ~F.coalesce(unusable, F.lit(True)))
    return rows.withColumn("vector", F.transform(value, lambda x: F.floor(x * steps).cast("long")))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _to_cells(pivots, width):
    centres = pivots.astype(np.float64)
    half = np.einsum("ij,ij->i", centres, centres) / 2

    def run(batches):
        for batch in batches:
            near = _matrix(batch.column("vector"), width).astype(np.float64) @ centres.T - half
            yield batch.append_column("cell", pa.array(near.argmax(1).astype(np.int32) if batch.num_rows else [], pa.int32()))

    return run


def _numbered(batches):
    group, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = (group << 40) + np.arange(seen, seen + batch.num_rows)
        seen += batch.num_rows
        batch = batch.append_column("group", pa.array(np.full(batch.num_rows, group, np.int32)))
        yield batch.append_column("row", pa.array(rows))


_FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
_FOUND_ARROW = pa.schema([(n, pa.int64()) for n in ("query", "query_id", "row", "vec_id", "score")])


def _ids(column) -> np.ndarray:
    return column.fill_null(_LONG).to_numpy()


def _found(best: Best, queries: np.ndarray, query_ids, names) -> pa.RecordBatch:
    """``names``: the id, or None, of a row number."""
    n, place = np.nonzero(best.rows >= 0)
    scores = pa.array([max(-_LONG - 1, min(_LONG, int(s))) for s in best.scores[n, place]], pa.int64())
    rows = best.rows[n, place]
    return pa.RecordBatch.from_arrays([pa.array(queries[n]), query_ids.take(pa.array(n)), pa.array(rows), names(rows), scores], schema=_FOUND_ARROW)


def _named(rows: np.ndarray, ids) -> callable:
    order = np.argsort(rows)

    def names(wanted):
        return ids.take(pa.array(order[np.searchsorted(rows, wanted, sorter=order)]))

    return names


def _exact_in_floats(width: int, largest: int) -> bool:
    return max(width, 1) * largest * largest < 2**53


def _at_home(width, largest, k):
    """Each partition is a group: its own queries against all its rows."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.concat_batches(held)
        asked = np.flatnonzero(table.column("asked").to_numpy(zero_copy_only=False))
        if not len(asked):
            return
        values, rows = _matrix(table.column("vector"), width), table.column("row").to_numpy()
        plain = _exact_in_floats(width, largest)
        ids = _ids(table.column("vec_id"))
        data = indexed(values, ids, rows, LEAF, plain)
        queries = indexed(values[asked], ids[asked], rows[asked], QUERY_LEAF, plain)
        best = Best(len(asked), k, float if plain else object)
        search(queries, data, best)
        mine = table.column("vec_id").take(pa.array(asked))
        yield _found(best, rows[asked], mine, _named(rows, table.column("vec_id")))

    return run


def _elsewhere(width, largest, k):
    """A group's rows come first, then blocks of queries of other groups with the scores they already have."""
    plain = _exact_in_floats(width, largest)
    kind = float if plain else object

    def run(batches):
        rows_of_group, data, names, block, number = [], None, None, [], None

        def answered():
            asked = pa.concat_batches(block)
            values, rows = _matrix(asked.column("vector"), width), asked.column("row").to_numpy()
            queries = indexed(values, _ids(asked.column("vec_id")), rows, QUERY_LEAF, plain)
            floors = np.array([-np.inf if s is None else s for s in asked.column("floor").to_pylist()], kind)
            best = Best(len(rows), k, kind, floors)
            search(queries, data, best)
            return _found(best, rows, asked.column("vec_id"), names)

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                if blocks[low] < 0:
                    rows_of_group.append(part)
                    continue
                if data is None:
                    if not rows_of_group:
                        return  # a group without rows
                    table = pa.concat_batches(rows_of_group)
                    rows = table.column("row").to_numpy()
                    data = indexed(_matrix(table.column("vector"), width), _ids(table.column("vec_id")), rows, LEAF, plain)
                    names, rows_of_group = _named(rows, table.column("vec_id")), []
                if block and blocks[low] != number:
                    yield answered()
                    block = []
                number = blocks[low]
                block.append(part)
        if block:
            yield answered()

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row where ``asked`` holds, the ``k`` best other rows.

    ``vectors`` has ``vec_id`` and ``vector`` (whole numbers), see :func:`stepped`.
    """
    spark = vectors.sparkSession
    size = F.size("vector")
    largest = F.max(F.when(size > 0, F.greatest(F.abs(F.array_max("vector").cast("decimal(20,0)")), F.abs(F.array_min("vector").cast("decimal(20,0)")))))
    rows = vectors.select("vec_id", "vector", F.coalesce(asked, F.lit(False)).alias("asked"))
    rows, seen = store(rows, "vectors", n=F.count("*"), width=F.max(size), parts=F.sum(size), largest=largest)
    width, top = seen["width"] or 0, int(seen["largest"] or 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-(seen["parts"] or 0) * 8 // GROUP_BYTES), min(tasks, -(-seen["n"] // GROUP_ROWS)))
    sample = [r.vector for r in rows.orderBy(F.xxhash64("vec_id")).limit(PIVOTS).select("vector").collect()]
    pivots = np.zeros((max(1, len(sample)), width), np.int64)
    for pivot, values in zip(pivots, sample, strict=False):
        pivot[: len(values)] = values
    celled = rows.mapInArrow(_to_cells(np.unique(pivots, axis=0), width), "vec_id bigint, vector array<bigint>, asked boolean, cell int")
    # a cell that holds many rows lies in several groups
    dealt = celled.repartitionByRange(groups, "cell", F.xxhash64("vec_id"), "vec_id").drop("cell")
    grouped = "vec_id bigint, vector array<bigint>, asked boolean, `group` int, row bigint"
    dealt, seen = store(dealt.mapInArrow(_numbered, grouped), "vector-groups", last=F.max("group"))
    groups = (seen["last"] or 0) + 1
    by_group = dealt.repartitionById(groups, "group")
    home, _ = store(by_group.mapInArrow(_at_home(width, top, k), _FOUND), "near-vectors")
    # below k rows there is no k-th score
    floors = home.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    queries = dealt.filter("asked").join(floors, F.col("row") == F.col("query"), "left")
    elsewhere = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g != F.col("group"))
    sent = queries.select(F.explode(elsewhere).alias("at"), F.floor(F.col("group") / HOMES).cast("long").alias("block"), "row", "vec_id", "vector", "floor")
    data = dealt.select(F.col("group").alias("at"), F.lit(-1).cast("long").alias("block"), "row", "vec_id", "vector", F.lit(None).cast("long").alias("floor"))
    met = data.unionByName(sent).repartitionById(groups, "at").sortWithinPartitions("at", "block")
    found = home.unionByName(met.mapInArrow(_elsewhere(width, top, k), _FOUND))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.select("query_id", order.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

