"""Substring dedup: shared k-mer seeds, collinear chains, aligned passages.

Seeds are hashes of ``K`` consecutive words, of which every window of ``W`` keeps the
smallest, so two texts that share a run of ``K + W - 1`` words share a seed whatever comes
before it. Every seed is tied to its first occurrence only, the one in the document with
the smallest id (the n-th in a text to the n-th there, and to the first): a seed that a third of all documents have gives one row per occurrence, never pairs of
occurrences. The seeds that a document shares with such an earlier document are chained: in
order in both texts, with a cost for gaps, the best predecessor found with a Fenwick tree.
Chains, those of one seed too, are aligned word by word, their ends moved outwards over changed
words, and kept from ``MIN_WORDS`` words and ``IDENTITY`` on.

A verbatim repeat needs no common first occurrence of its seeds: two equal runs of ``MIN_WORDS``
words have equal seeds in every window, so all runs that lack none of the seeds that several documents
have are hashed as a whole and joined with the first occurrence of the same run. So every
word of such a run that an earlier document has lies in a passage; passages that a chain's
passage with the same document holds are left out.

Seeds with words outside all these passages are then tied to every earlier occurrence, not the first alone, and go
the same way again. A seed in at most ``FEW`` places is joined with itself. For others two places are a pair only if
the ``REACH`` words on either side may hold a passage: ``MIN_WORDS`` words of which ``IDENTITY`` are aligned
have ``SHARED`` pairs of neighbouring words in common, within at most ``MIN_WORDS`` + ``ERRORS`` words. So once each stretch
of that length has left out its ``SHARED`` - 1 most frequent ones, two such places still share one (prefix filter). Pairs of words
that the same places have, such as those of a longer phrase, are joined once for all. A short phrase that a third of all
documents have makes rows per place, not per pair of places; places that share more than that are compared with one another.
The places of a seed with at most ``MANY`` are compared so by one task that has the words around them all, those of others by joins.

Seeds, runs, places and chains are worked off in parts by their hash where they are many next to the words of all texts,
so that the files of a join go before those of the next part come.

Texts are split once. From there on a word is 32 bits of its hash: equal words are equal, and two
different ones are taken for one another once in four thousand million comparisons. Only seeds, the
words around chains and the runs whose seeds all occur elsewhere are shuffled. Documents that are equal as a whole need no alignment.

Cases: NULL and empty texts, those without words and rows without an id have no passages.
Texts shorter than ``MIN_WORDS`` words have none either. Rows that repeat an id are one
document for the search: different texts of one id are seeded, chained and cut one by one, but tied to
smaller ids only. Passages that repeat only inside one document are not reported.
Texts of any length are seeded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import lt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import free_name
from assay.plans.storing import discard, release, store, store_parts

K, W = 5, 8
MIN_WORDS, IDENTITY = 50, 0.8
GAP_COST, MAX_GAP = 0.125, 64
REACH = MAX_GAP
#: Errors cost as many equal words when ends are moved outwards, tried in this order; ``DROP`` of them end the search.
ERROR_COSTS, DROP = (3, 4, 2, 1), 8
#: Errors around a chain, half as many again as ``IDENTITY`` allows in ``MIN_WORDS`` words, before its texts are looked at.
ERRORS = round(MIN_WORDS * (1 - IDENTITY) * 1.5)
#: Pairs of neighbouring words that two passages share at least: their aligned words less the runs these can be in, with all others spread.
SHARED = round(MIN_WORDS * IDENTITY) - 2 * round(MIN_WORDS * (1 - IDENTITY)) - 1
#: Places of a seed up to which all of them are compared without that test.
FEW = 32
#: Places of a seed up to which one task compares them.
MANY = 4096
#: Pairs of places that are looked at at once.
PAIRS_AT_ONCE = 1 << 21
#: Rows that are worked off at once, however few words there are.
LEAST_AT_ONCE = 1 << 18
#: Bytes of texts whose seeds a task finds at once.
BYTES_AT_ONCE = 1 << 19
_NONE = np.uint64(2**64 - 1)
_BYTES = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
_DEAD = np.int64(-(2**40))
_AHEAD = np.arange(64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


_SEEDS = pa.schema(
    [("seed", pa.int64()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("digest", pa.int64())]
    + [("marks", pa.binary()), ("near", pa.binary())]
)


def _stored(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    return store(df, label, codec="zstd", **metrics)


def _parts(key: str, rows: int, at_once: int) -> list[Column]:
    """Conditions that part ``rows`` rows by the hash of ``key``, into as many parts as have about ``at_once`` rows each."""
    n = max(1, -(-rows // max(at_once, LEAST_AT_ONCE)))
    return [F.pmod(F.xxhash64(key), F.lit(n)) == i if n > 1 else F.lit(True) for i in range(n)]


def words_of(text: str | Column) -> Column:
    """The words of a text, parted by white space."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_extract_all(column, F.lit(r"\S+"), F.lit(0))


def _slid(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` over values[i : i + size], for every i; shorter at the end."""
    out, done = values.copy(), 1
    while done < size:
        step = min(done, size - done)
        out[:-step] = pick(out[:-step], out[step:])
        done += step
    return out


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = (left ^ (right >> np.uint64(31)) ^ (right << np.uint64(33))) * _FACTOR
    return mixed ^ (mixed >> np.uint64(29))


def seeds(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, position, hash) of the seeds of texts given as word hashes one after another."""
    counts = np.maximum(sizes - K + 1, 0)
    starts = np.cumsum(sizes) - sizes
    # every text is followed by W places without a seed, so no window sees two texts
    places = counts + W
    base = np.cumsum(places) - places
    text = np.repeat(np.arange(len(sizes)), counts)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[text] + pos
    rolled = np.zeros(len(text), np.uint64)
    for i in range(K):
        rolled = (rolled ^ words[first + i]) * _FACTOR
        rolled ^= rolled >> np.uint64(29)
    laid = np.full(int(places.sum()), _NONE)
    laid[base[text] + pos] = np.minimum(rolled, _NONE - np.uint64(1))
    lowest = _slid(laid, W, np.minimum)  # of the window that begins here
    # a window counts if it lies inside its text, or is all there is of a short one
    inside = np.zeros(len(laid), bool)
    windows = np.where(counts > 0, np.maximum(counts - W + 1, 1), 0)
    begin = np.repeat(base, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    inside[begin] = True
    shown = np.where(inside, lowest, np.uint64(0))
    highest = _slid(np.concatenate([np.zeros(W - 1, np.uint64), shown]), W, np.maximum)[: len(laid)]
    kept = (laid != _NONE) & (laid <= highest)
    picked = kept[base[text] + pos]
    return text[picked], pos[picked], rolled[picked]


def _nth(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 for a seed's first occurrence in its text, 2 for the next and so on."""
    order = np.lexsort((value, text))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(value[order].view(np.int64)) != 0)
    heads = np.flatnonzero(new)
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order)))) + 1
    return out


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) with about ``most`` bytes together, one row at least."""
    ends, first = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
    while first < len(texts):
        begun = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begun + most, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word: its bytes as drawn numbers, weighed by their places and added up, then mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    sizes = np.diff(ends)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    place = np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], sizes)
    weights = np.cumprod(np.full(int(sizes.max(initial=0)), _FACTOR))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * weights[place])])
    mixed = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
    for _ in range(2):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _FACTOR
    return mixed ^ (mixed >> np.uint64(29))


def _seed_rows(batches):
    """The seeds, and for each document the marks of its words: 32 bits of each word's hash, equal for equal words."""
    for batch in batches:
        for start, texts in _slices(batch.column(1), BYTES_AT_ONCE):
            ids, digests = (batch.column(i).slice(start, len(texts)) for i in (0, 2))
            lists = pc.ascii_split_whitespace(texts)
            flat = lists.flatten()
            some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty words there
            coded = flat.filter(some).dictionary_encode()
            words = _hashes(coded.dictionary)[coded.indices.to_numpy()]
            sizes = np.bincount(pc.list_parent_indices(lists).filter(some).to_numpy(), minlength=len(texts))
            bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
            own = {"doc_id": ids, "digest": digests}
            for name, kind in (("marks", np.uint32), ("near", np.uint8)):
                flat, width = words.astype(kind).tobytes(), np.dtype(kind).itemsize
                own[name] = pa.array([flat[a * width : b * width] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([own.get(f.name, pa.nulls(len(ids), f.type)) for f in _SEEDS], schema=_SEEDS)
            text, pos, value = seeds(words, sizes)
            taken = pa.array(text)
            columns = [value.view(np.int64), _nth(text, value), ids.take(taken), pos.astype(np.int32), sizes[text].astype(np.int32), digests.take(taken), *[pa.nulls(len(text), pa.binary())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_SEEDS)


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of matches (x, y), best first, each match in one chain; matches are sorted by (x, y).

    A chain scores K per match less ``GAP_COST`` per word it moves on in either text. The
    cost is linear, so the best predecessor of a match is the prefix maximum, over smaller y,
    of score + cost so far, which a Fenwick tree keeps. Chains are cut where they move on by
    more than ``MAX_GAP`` words.
    """
    score, before = [0.0] * len(x), [-1] * len(x)
    i = 0
    if all(map(lt, x, x[1:])) and all(map(lt, y, y[1:])):  # then the match before is the best predecessor
        for i in range(len(x)):
            linked = score[i - 1] - GAP_COST * (x[i] - x[i - 1] + y[i] - y[i - 1]) if i else 0
            score[i] = K + max(linked, 0)
            before[i] = i - 1 if linked > 0 else -1
        i = len(x)
    else:
        ranks = {value: i + 1 for i, value in enumerate(sorted(set(y)))}
        tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:  # matches with the same x don't follow each other
            best, at = (float("-inf"), -1), ranks[y[j]] - 1
            while at > 0:
                best = max(best, tree[at])
                at -= at & -at
            score[j] = K
            linked = best[0] - GAP_COST * (x[j] + y[j])
            if linked > 0:
                score[j], before[j] = K + linked, best[1]
            j += 1
        for m in range(i, j):
            entry, at = (score[m] + GAP_COST * (x[m] + y[m]), m), ranks[y[m]]
            while at < len(tree):
                tree[at] = max(tree[at], entry)
                at += at & -at
        i = j
    found, used = [], [False] * len(x)
    for end in sorted(range(len(x)), key=lambda m: (-score[m], m)):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = before[end]
        chain.reverse()
        cuts = [k for k in range(1, len(chain)) if max(x[chain[k]] - x[chain[k - 1]], y[chain[k]] - y[chain[k - 1]]) > MAX_GAP]
        found += [chain[a:b] for a, b in zip([0, *cuts], [*cuts, len(chain)], strict=True) if b > a]
    return found


_CHAINED = "doc_id bigint, ref_id bigint, x array<int>, y array<int>, whole boolean"


def _chained(batches):
    """Matches come sorted by (doc_id, ref_id, pos, ref_pos); a pair may lie across batches."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        if not held.num_rows:
            continue
        doc, ref = held.column(0).to_numpy(), held.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(ref) != 0)]))
        yield from _pairs(held, starts)
        held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield from _pairs(held, np.array([0, held.num_rows]))


def _pairs(rows, starts):
    doc, ref, x, y, size = (rows.column(i).to_numpy() for i in (0, 1, 2, 3, 4))
    whole = rows.column(5).to_numpy(zero_copy_only=False)
    out = []
    for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        pair = (int(doc[first]), int(ref[first]))
        if whole[first]:
            if size[first] >= MIN_WORDS:
                out.append((*pair, [0, int(size[first])], [0, int(size[first])], True))
        elif size[first] >= MIN_WORDS:
            xs, ys = x[first:last].tolist(), y[first:last].tolist()
            for chain in chains(xs, ys) if len(xs) > 1 else [[0]]:
                out.append((*pair, [xs[i] for i in chain], [ys[i] for i in chain], False))
    for start in range(0, len(out), 5000):
        columns = list(zip(*out[start : start + 5000], strict=True))
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "ref_id", "x", "y", "whole"])


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence; the bits of a number are a row of the table, 0 where it rises."""
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for word in b:
        if word in places:
            rises = row & places[word]
            row = ((row + rises) | (row - rises)) & full
    return len(a) - row.bit_count()


def extended(
    a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, step: np.ndarray, cost: np.ndarray | int
) -> tuple[np.ndarray, np.ndarray]:
    """How far the alignment with the most equal words, less ``cost`` per error (of all or of each), goes in ``a`` and in ``b``, for many pairs at once.

    Pair r reads ``n_a[r]`` words of ``a`` from ``at_a[r]`` on, forwards or backwards as ``step[r]`` says, and ``b`` likewise.
    All go on error by error, with the furthest place that each shift between the two reaches; a shift ends once it is
    ``DROP`` errors below the best, and a pair once all its shifts have. Of equal alignments the one of fewer errors
    counts, then the one that shifts less.
    """
    best, end_a, end_b = (np.zeros(len(at_a), np.int64) for _ in range(3))
    far, shift, pair, errors = np.zeros((len(at_a), 1), np.int64), np.zeros(1, np.int64), np.arange(len(at_a)), 0
    cost = np.broadcast_to(np.asarray(cost, np.int64), len(at_a))
    while len(pair):
        row, col = np.nonzero(far >= 0)
        ahead = _AHEAD[: 16 if errors else 4]
        while len(row):  # some words at once; those that are all equal go on
            i, r = far[row, col], pair[row]
            j = i + shift[col]
            room, go = np.minimum(n_a[r] - i, n_b[r] - j), step[r]
            k = np.minimum(ahead, np.maximum(room - 1, 0)[:, None]) * go[:, None]
            # where no word is left, the first of all are read and not counted
            first_a, first_b = (np.where(room > 0, at[r] + go * x, 0)[:, None] for at, x in ((at_a, i), (at_b, j)))
            k[room <= 0] = 0
            differ = (a[first_a + k] != b[first_b + k]) | (ahead >= room[:, None])
            same = np.where(differ.any(1), differ.argmax(1), len(ahead))
            far[row, col] += same
            more = same == len(ahead)
            row, col, ahead = row[more], col[more], _AHEAD
        costs = cost[pair]
        score = np.where(far >= 0, (2 * far + shift) // 2 - errors - (costs * errors)[:, None], _DEAD)
        top = best[pair] - DROP * costs
        order = np.lexsort((shift < 0, np.abs(shift)))
        first = order[score[:, order].argmax(1)]
        every = np.arange(len(pair))
        better = score[every, first] > best[pair]
        won, first = pair[better], first[better]
        best[won], end_a[won] = score[better, first], far[better, first]
        end_b[won] = end_a[won] + shift[first]
        far = np.where(score > top[:, None], far, _DEAD)
        alive = (far >= 0).any(1)
        far, pair = far[alive], pair[alive]
        more_a = (far >= 0) & (far < n_a[pair][:, None])
        more_b = (far >= 0) & (far + shift < n_b[pair][:, None])
        after = np.full((len(pair), len(shift) + 2), _DEAD)
        after[:, 1:-1] = np.where(more_a & more_b, far + 1, _DEAD)
        after[:, 2:] = np.maximum(after[:, 2:], np.where(more_b, far, _DEAD))
        after[:, :-2] = np.maximum(after[:, :-2], np.where(more_a, far + 1, _DEAD))
        alive, used = (after >= 0).any(1), (after >= 0).any(0)
        shift = np.concatenate([shift[:1] - 1, shift, shift[-1:] + 1])[used]
        far, pair, errors = after[alive][:, used], pair[alive], errors + 1
    return end_a, end_b


def _same(a: list, b: list) -> int:
    return len(a) if a == b else common(a, b)


def align(pairs: list[tuple[np.ndarray, np.ndarray, list[int], list[int]]]) -> list[list[tuple[int, int, int, int, float]]]:
    """(begin, end, begin, end, identity) of the passages around matches at (x, y) in ``a`` and ``b``, for each (a, b, x, y).

    The ends are moved outwards as far as ``extended`` says. Between two matches the words are
    aligned; identity is the share of aligned words of the longer side. A chain below
    ``IDENTITY`` is parted where most words differ and its parts are looked at again, so that
    what lies between two passages does not cost them both.
    """
    if not pairs:
        return []
    flat = [np.concatenate([p[side] for p in pairs]) for side in (0, 1)]
    sizes = np.array([(len(p[0]), len(p[1])) for p in pairs], np.int64)
    base = np.cumsum(sizes, 0) - sizes
    total, lost = [], []  # of equal words up to each match; of others between a match and the one before
    for a, b, x, y in pairs:
        sums, gaps = [0], [0]
        if len(x) > 1:
            words_a, words_b = a[x[0] : x[-1]].tolist(), b[y[0] : y[-1]].tolist()
        for i in range(1, len(x)):
            left, right = words_a[x[i - 1] - x[0] : x[i] - x[0]], words_b[y[i - 1] - y[0] : y[i] - y[0]]
            same = _same(left, right)
            sums.append(sums[-1] + same)
            gaps.append(max(len(left), len(right)) - same)
        total.append(sums)
        lost.append(gaps)

    def moved(parts: list[tuple[int, int, int]], cost: np.ndarray | int) -> list[tuple[int, int, int, int]]:
        n, begins = np.array([p[0] for p in parts]), []
        for side in (0, 1):
            begins.append([np.array([pairs[p][2 + side][k] for p, k in ends], np.int64) for ends in ([(p, f) for p, f, _ in parts], [(p, e) for p, _, e in parts])])
        (x0, x1), (y0, y1) = begins
        at_a, at_b = (np.concatenate([base[n, side] + first - 1, base[n, side] + last]) for side, (first, last) in enumerate(begins))
        n_a, n_b = np.concatenate([x0, sizes[n, 0] - x1]), np.concatenate([y0, sizes[n, 1] - y1])
        i, j = extended(*flat, at_a, at_b, n_a, n_b, np.repeat([-1, 1], len(n)), np.tile(cost, 2) if np.ndim(cost) else cost)
        ends = x0 - i[: len(n)], x1 + i[len(n) :], y0 - j[: len(n)], y1 + j[len(n) :]
        return list(zip(*(e.tolist() for e in ends), strict=True))

    found: list[list[tuple[int, int, int, int, float]]] = [[] for _ in pairs]
    parts, parted = [(p, 0, len(pair[2]) - 1) for p, pair in enumerate(pairs)], False
    span = lambda part: pairs[part[0]][2][part[2]] - pairs[part[0]][2][part[1]]
    while parts:
        known, least = {}, min(ERROR_COSTS)

        def learn(wanted: list[tuple[tuple[int, int, int], int]]) -> None:
            if wanted:
                known.update(zip(wanted, moved([part for part, _ in wanted], np.array([c for _, c in wanted])), strict=True))

        # parts of parts go far, however many they are: all costs are tried at once
        learn([(part, c) for c in ERROR_COSTS for part in parts] if parted else [(part, least) for part in parts if span(part) < MIN_WORDS])
        # no other cost leads further
        left = [part for part in parts if span(part) >= MIN_WORDS or known[part, least][1] - known[part, least][0] >= MIN_WORDS]
        for n, cost in enumerate(ERROR_COSTS):
            if n < 2:  # few need more than the first
                learn([(part, c) for c in (ERROR_COSTS[1:] if n else [cost]) for part in left if (part, c) not in known])
            below = []
            for part in left:
                begin, end, begin_b, end_b = known[part, cost]
                p, first, last = part
                a, b, x, y = pairs[p]
                longer = max(end - begin, end_b - begin_b)
                if end - begin >= MIN_WORDS:
                    aligned = total[p][last] - total[p][first] + sum(
                        _same(a[i:j].tolist(), b[k:m].tolist()) for i, j, k, m in ((begin, x[first], begin_b, y[first]), (x[last], end, y[last], end_b))
                    )
                    if aligned / longer >= IDENTITY:
                        found[p].append((begin, end, begin_b, end_b, aligned / longer))
                        continue
                below.append(part)
            left = below
        parts, parted = [], True
        for p, first, last in left:
            if last > first:
                worst = max(range(first + 1, last + 1), key=lost[p].__getitem__)
                parts += [(p, first, worst - 1), (p, worst, last)]
    return [sorted(passages) for passages in found]


def _by_document(build, kinds, many: bool = False):
    """Batches of rows sorted by their first column, put together so that no value is parted, go through ``build``, which gives columns or ``many`` lists of them."""

    def built(rows):
        for columns in build(rows) if many else [build(rows)]:
            yield pa.RecordBatch.from_pydict(dict(zip(kinds, columns, strict=True)))

    def read(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            if not held.num_rows:
                continue
            last = int(np.searchsorted(held.column(0).to_numpy(), held.column(0)[held.num_rows - 1].as_py()))
            if last:
                yield from built(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from built(held)

    return read


def _spans(rows):
    """Stretches of words of the seeds (doc_id, pos, size) that several documents have: all their runs have such a seed in every window."""
    doc, pos, size = (rows.column(i).to_numpy().astype(np.int64) for i in range(3))
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(pos) > W)]))
    last = pos[np.append(heads[1:], len(pos)) - 1]
    # a run's first window begins with it and has to reach the first of the seeds, its last one the last of them
    low, high = np.maximum(pos[heads] - W + 1, 0), np.minimum(last + K + W - 1, size[heads])
    kept = high - low >= MIN_WORDS
    return pa.array(doc[heads][kept]), pa.array(low[kept].astype(np.int32)), pa.array((high - low)[kept].astype(np.int32))


def _padded(column: pa.Array, backwards: bool, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks as rows of a matrix that go on with ``fill``, and how many there are of each."""
    sizes = pc.binary_length(column).to_numpy().astype(np.int64)
    flat = np.frombuffer(b"".join(column.to_pylist()) + bytes(REACH + K + 1), np.uint8)
    ends, at = np.cumsum(sizes), np.arange(REACH + K + 1)
    # places before the first mark come round from the end, and are filled like those behind the last one
    places = ends[:, None] - 1 - at if backwards else (ends - sizes)[:, None] + at
    return np.where(at < sizes[:, None], flat[places], np.int16(fill)), sizes


def reached(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, errors: int) -> np.ndarray:
    """How far into each row of ``a`` an alignment with the row of ``b`` comes, for 0 to ``errors`` errors."""
    shift = np.arange(-errors, errors + 1, dtype=np.int32)
    limit = np.minimum(size_a[:, None], size_b[:, None] - shift).astype(np.int32)
    every = np.full(limit.shape, -2 * errors - 2, np.int32)
    every[:, errors] = 0
    out = np.zeros((len(a), errors + 1), np.int64)
    for e in range(errors + 1):
        near = slice(errors - e, errors + e + 1)  # more than e errors apart nothing is reached yet
        far, shift = every[:, near], np.arange(-e, e + 1, dtype=np.int32)
        if e:
            before = far.copy()
            far += 1
            np.maximum(far[:, 1:], before[:, :-1], out=far[:, 1:])
            np.maximum(far[:, :-1], before[:, 1:] + 1, out=far[:, :-1])
            np.minimum(far, limit[:, near], out=far)
        row, col = np.nonzero((far >= 0) & (far + shift >= 0))
        while len(row):
            i = far[row, col]
            same = a[row, i] == b[row, i + shift[col]]
            row, col = row[same], col[same]
            far[row, col] += 1
        out[:, e] = far.max(1)
    return out


def reachable(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, errors: int) -> np.ndarray:
    """No less than ``reached``: a word that ``b`` doesn't have within ``errors`` places costs an error."""
    lacks = np.ones(a.shape, bool)
    for shift in range(-errors, errors + 1):
        at = slice(max(-shift, 0), a.shape[1] - max(shift, 0))
        lacks[:, at] &= a[:, at] != b[:, at.start + shift : at.stop + shift]
    lost = np.cumsum(lacks, 1, dtype=np.int16)
    return np.minimum(np.stack([(lost <= e).sum(1) for e in range(errors + 1)], 1), size_a[:, None])


def _long_enough(batches):
    """Chains around which enough words may agree: ``MIN_WORDS`` with ``ERRORS`` errors in all."""
    for batch in batches:
        sides = [_padded(batch.column(2 + i), i % 2 == 0, -1 - i // 2) for i in range(4)]
        open_rows, words = np.arange(batch.num_rows), batch.column(1).to_numpy()
        for exact in (False, True):
            (a0, m0), (a1, m1), (b0, n0), (b1, n1) = ((marks[open_rows], size[open_rows]) for marks, size in sides)
            if exact:
                left, right = reached(a0, b0, m0, n0, ERRORS), reached(a1, b1, m1, n1, ERRORS)
            else:
                left, right = reachable(a0, b0, m0, ERRORS), reachable(a1, b1, m1, ERRORS)
            right = np.maximum.accumulate(right, 1)[:, ::-1]
            enough = (np.maximum.accumulate(left, 1) + right).max(1) + words[open_rows] >= MIN_WORDS
            open_rows = open_rows[enough]
        yield pa.RecordBatch.from_pydict({"chain": batch.column(0).take(pa.array(open_rows))})


def _run_rows(batches):
    for batch in batches:
        words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).astype(np.uint64) * _FACTOR
        sizes = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // 4
        n = np.maximum(sizes - MIN_WORDS + 1, 0)
        text = np.repeat(np.arange(len(sizes)), n)
        first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        hashed = _slid(words, MIN_WORDS, _mixed)[(np.cumsum(sizes) - sizes)[text] + first]
        pos = batch.column(1).to_numpy()[text] + first
        yield pa.RecordBatch.from_pydict({"run": pa.array(hashed.view(np.int64)), "doc_id": batch.column(0).take(pa.array(text)), "pos": pa.array(pos.astype(np.int32))})


def _joined_runs(rows):
    """Passages of equal runs (doc_id, ref_id, shift, pos), as few per document and partner as have all their words."""
    doc, ref, shift, pos = (rows.column(i).to_numpy().astype(np.int64) for i in range(4))
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(ref) != 0) | (np.diff(shift) != 0) | (np.diff(pos) > MIN_WORDS)])
    heads = np.flatnonzero(new)
    begin, end = pos[heads], pos[np.append(heads[1:], len(pos)) - 1] + MIN_WORDS
    doc, ref, shift = doc[heads], ref[heads], shift[heads]
    kept, best, pair, until = [], -1, None, 0
    for i in np.lexsort((-end, begin, ref, doc)).tolist():
        if (doc[i], ref[i]) != pair:
            if best >= 0:
                kept.append(best)
            pair, until, best = (doc[i], ref[i]), -1, -1
        if best >= 0 and begin[i] > until:  # what is covered so far ends before this one: the longest held back is needed
            kept.append(best)
            until, best = end[best], -1
        if end[i] > until and (best < 0 or end[i] > end[best]):
            best = i
            if begin[i] > until:
                kept.append(best)
                until, best = end[i], -1
    if best >= 0:
        kept.append(best)
    chosen = np.array(kept, np.int64)
    columns = (doc, begin, end, ref, begin + shift, end + shift)
    return *(pa.array(c[chosen].astype(np.int64 if i in (0, 3) else np.int32)) for i, c in enumerate(columns)), pa.array(np.ones(len(chosen)))


def _open_seeds(rows):
    """Places of seeds (doc_id, pos, nth, seed, size), one for each run of the same seed, and whether words of them are outside the passages (doc_id, pos, end)."""
    doc, pos, nth, seed, size, end = (rows.column(i).to_numpy().astype(np.int64) for i in range(6))
    heads = np.flatnonzero(np.concatenate([[True], np.diff(doc) != 0]))
    number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(doc))))
    places = np.maximum.reduceat(np.maximum(pos + K, end), heads) + 1
    at = (np.cumsum(places) - places)[number] + pos
    passage = end > 0
    edges = np.zeros(int(places.sum()) + 1, np.int64)
    np.add.at(edges, at[passage], 1)
    np.add.at(edges, (at + end - pos)[passage], -1)
    outside = np.concatenate([[0], np.cumsum(np.cumsum(edges) == 0)])
    kept = np.flatnonzero(~passage)
    kept = kept[np.lexsort((pos[kept], seed[kept], doc[kept]))]
    if not len(kept):
        return [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())]
    open_places = outside[at[kept] + K] > outside[at[kept]]
    doc, pos, nth, seed, size = (c[kept] for c in (doc, pos, nth, seed, size))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(seed) != 0) | (np.diff(pos) > 1)]))
    open_places = np.logical_or.reduceat(open_places, first)
    return [pa.array(c[first].astype(t)) for c, t in ((doc, np.int64), (pos, np.int32), (nth, np.int32), (seed, np.int64), (size, np.int32))] + [pa.array(open_places)]


def _pairs_around(seed: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the place, which pair there, the pair as one number with the seed and which of equal ones it is) of the neighbouring words around places."""
    sizes = pc.binary_length(words).to_numpy().astype(np.int64) // 4
    flat = np.frombuffer(b"".join(words.to_pylist()), np.uint32).astype(np.uint64)
    n = np.maximum(sizes - 1, 0)
    place = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(sizes) - sizes)[place] + nth
    value = _mixed(flat[first] * _FACTOR, flat[first + 1])
    return place, nth, _mixed(_mixed(value, _nth(place, value).astype(np.uint64)), seed.to_numpy().view(np.uint64)[place]).view(np.int64)


def _word_pairs(batches):
    """Pairs of words around places (seed, spot, words); ``spot`` is that of the first pair."""
    for batch in batches:
        place, nth, value = _pairs_around(batch.column(0), batch.column(2))
        yield pa.RecordBatch.from_pydict({"token": pa.array(value), "spot": pa.array(batch.column(1).to_numpy()[place] + nth)})


def outranked(place: np.ndarray, offset: np.ndarray, rank: np.ndarray, size: int, wanted: np.ndarray) -> np.ndarray:
    """How many of the same place rank higher, at most, in a stretch of ``size`` offsets with it, for the ``wanted`` rows; ranks are above 0."""
    places = 2 * REACH + K
    ranks = np.zeros((place[-1] + 1, places), np.int32)
    ranks[place, offset] = rank
    out = np.zeros(len(wanted), np.int64)
    for begin in range(0, len(wanted), 4096):
        rows = wanted[begin : begin + 4096]
        higher = np.zeros((len(rows), places + size), np.uint8)  # before each offset
        np.cumsum(ranks[place[rows]] > rank[rows, None], 1, dtype=np.uint8, out=higher[:, 1 : places + 1])
        higher[:, places + 1 :] = higher[:, places, None]
        held = higher[:, 1:].copy()  # in the stretch that ends with each offset
        held[:, size - 1 :] -= higher[:, :places]
        out[begin : begin + len(rows)] = np.take_along_axis(held, offset[rows, None] + np.arange(size), 1).max(1)
    return out


def _rare_pairs(rows):
    """Of the pairs of words (at, offset, token, n): those that two places with a passage share one of, and whether it is one for the later of them, too."""
    at, offset, token, n = (rows.column(i).to_numpy().astype(np.int64) for i in range(4))
    place = np.cumsum(np.concatenate([[False], np.diff(at) != 0]))
    rank = np.empty(len(at), np.int64)
    rank[np.lexsort((token, n))] = np.arange(1, len(at) + 1)
    kept = np.flatnonzero(outranked(place, offset, rank, MIN_WORDS + ERRORS - 1, np.arange(len(at))) >= SHARED - 1)
    own = outranked(place, offset, rank, MIN_WORDS - 1, kept) >= SHARED - 1
    return pa.array(token[kept]), pa.array(at[kept]), pa.array(own & (at[kept] % 2 == 1))


def _alike_places(rows):
    """Matches (doc_id, pos, ref_id, ref_pos, size) of places (seed, doc_id, pos, usable, size, lead, words), sorted so, that share one of ``_rare_pairs``; seeds are whole."""
    doc, pos, usable, size, lead = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 6))
    place, nth, value = _pairs_around(rows.column(0), rows.column(6))
    _, token, n = np.unique(value, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(n[token] > 1)
    place, token = place[kept], token[kept]
    if not len(kept):
        return
    # numbered in the order of the documents, odd if usable
    columns = place * 2 + usable[place], lead[place] + nth[kept], token, n[token]
    token, at, own = (c.to_numpy(zero_copy_only=False) for c in _rare_pairs(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "offset", "token", "n"])))
    order = np.lexsort((at, token))
    token, at, own = token[order], at[order] // 2, own[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(token) != 0])) if len(token) else np.zeros(0, np.int64)
    head = np.repeat(heads, np.diff(np.append(heads, len(token))))
    mine = np.flatnonzero(own)
    mine = mine[np.argsort(at[mine], kind="stable")]
    # each of them and all before it that have the same pair of words
    before = np.cumsum(mine - head[mine])
    ends = np.flatnonzero(np.concatenate([np.diff(at[mine]) != 0, [True]])) + 1 if len(mine) else []
    first = 0
    while first < len(mine):
        begun = before[first - 1] if first else 0
        i = np.searchsorted(before[ends - 1], begun + PAIRS_AT_ONCE, side="right")
        last = max(ends[max(i - 1, 0)], ends[np.searchsorted(ends, first, side="right")])
        some = mine[first:last]
        counts = some - head[some]
        other = np.repeat(head[some], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        a, b = np.divmod(np.unique(np.repeat(at[some], counts) * len(doc) + at[other]), len(doc))
        later = doc[a] > doc[b]
        a, b = a[later], b[later]
        yield [pa.array(c.astype(t)) for c, t in ((doc[a], np.int64), (pos[a], np.int32), (doc[b], np.int64), (pos[b], np.int32), (size[a], np.int32))]
        first = last


def _other_places(rows: DataFrame, known: DataFrame, marks: DataFrame, n_words: int) -> DataFrame:
    """Matches of seeds that have words outside the ``known`` passages with all their earlier places that were not tried, see the top."""
    given = rows.select("doc_id", "pos", "nth", "seed", "size", F.lit(0).alias("end"))
    cuts = known.select("doc_id", F.col("begin").alias("pos"), F.lit(0).alias("nth"), F.lit(0).cast("long").alias("seed"), F.lit(0).alias("size"), "end")
    kinds = {"doc_id": "bigint", "pos": "int", "nth": "int", "seed": "bigint", "size": "int", "open": "boolean"}
    both = given.unionByName(cuts).repartition("doc_id").sortWithinPartitions("doc_id")
    places, _ = _stored(both.mapInArrow(_by_document(_open_seeds, list(kinds)), ", ".join(f"{n} {t}" for n, t in kinds.items())), "places")
    usable = F.col("open") & (F.col("size") >= MIN_WORDS)
    groups = places.groupBy("seed").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max(F.when(usable, F.col("doc_id"))).alias("last"))
    # the first document alone has been tried
    groups, _ = _stored(groups.filter("n > 2 AND last > least"), "open-seeds")
    release(rows.sparkSession)
    placed, seen = _stored(places.join(groups, "seed").drop("last"), "open-places", crowded=F.count_if(F.col("n") > MANY))
    discard(places, groups)
    pair = ["doc_id", "pos", "ref_id", "ref_pos", "size"]
    begin = F.greatest(F.col("pos") - REACH, F.lit(0))
    around = F.substring("marks", begin * 4 + 1, (F.col("pos") + K + REACH - begin) * 4)
    lead = begin - F.col("pos") + REACH
    places = placed.select("seed", "doc_id", "pos", "nth", "size", "n", "least", usable.alias("usable"))

    def parts() -> Iterator[DataFrame]:
        few = places.filter(F.col("n") <= FEW)
        other = few.select("seed", F.col("doc_id").alias("ref_id"), F.col("pos").alias("ref_pos"), F.col("nth").alias("ref_nth"))
        few = few.filter("usable").join(other, "seed").filter("doc_id > ref_id")
        yield few.filter("ref_id > least OR (ref_nth > 1 AND ref_nth <> nth)").select(*pair)
        some = places.filter((F.col("n") > FEW) & (F.col("n") <= MANY)).join(marks, "doc_id")
        some = some.select("seed", "doc_id", "pos", "usable", "size", lead.alias("lead"), around.alias("words")).repartition("seed").sortWithinPartitions("seed", "doc_id", "pos")
        yield some.mapInArrow(_by_document(_alike_places, pair, many=True), "doc_id bigint, pos int, ref_id bigint, ref_pos int, size int")
        if seen["crowded"]:
            spots = places.filter(F.col("n") > MANY)
            yield from _crowded_places(spots, marks, lead, around, seen["crowded"], n_words)

    matches = store_parts(parts(), "other-matches", codec="zstd")
    discard(placed)
    return matches


def _crowded_places(spots: DataFrame, marks: DataFrame, lead: Column, around: Column, n_spots: int, n_words: int) -> Iterator[DataFrame]:
    """Matches as those of ``_alike_places``, found by joins, for seeds that have more places than a task compares."""
    # numbered in the order of the documents, odd if usable; rows of word pairs are two numbers, the last 8 bits say where in the place
    at = F.shiftleft(F.monotonically_increasing_id(), 1).bitwiseOR(F.col("usable").cast("long"))
    spots, _ = _stored(spots.select("seed", "doc_id", "pos", "size", "usable").orderBy("doc_id", "pos").select("*", at.alias("at")), "spots")
    words, _ = _stored(spots.join(marks, "doc_id").select("seed", (F.shiftleft("at", 8) + lead).alias("spot"), around.alias("words")), "around")
    release(spots.sparkSession)
    for part in _parts("seed", n_spots * (2 * REACH + K), n_words // 8):
        tokens, _ = _stored(words.filter(part).mapInArrow(_word_pairs, "token bigint, spot bigint"), "word-pairs")
        frequent, _ = _stored(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "frequent-pairs")
        release(spots.sparkSession)
        # a place has at most 2 * REACH + K pairs
        placed = tokens.join(frequent, "token").select(F.shiftright("spot", 8).alias("at"), F.col("spot").bitwiseAND(F.lit(255)).cast("int").alias("offset"), "token", "n")
        common_pairs = placed.repartition("at").sortWithinPartitions("at", "offset")
        rare, _ = _stored(common_pairs.mapInArrow(_by_document(_rare_pairs, ["token", "at", "own"]), "token bigint, at bigint, own boolean"), "rare-pairs")
        discard(tokens, frequent)
        same = [F.bit_xor(F.xxhash64(F.lit(i), "at", "own")).alias(f"same{i}") for i in range(2)]  # equal for equal places
        alike = rare.groupBy("token").agg(*same, F.count("*").alias("n"), F.count_if("own").alias("own")).filter("n > 1 AND own > 0")
        alike = alike.groupBy("same0", "same1").agg(F.min("token").alias("token"), F.max(F.col("n") * F.col("own")).alias("pairs"))
        alike, made = _stored(alike.select("token", "pairs"), "alike-pairs", pairs=F.sum("pairs"))
        chosen, _ = _stored(rare.join(alike.select("token"), "token", "left_semi"), "rare-places")
        discard(rare, alike)
        for some in _parts("at", made["pairs"] or 0, n_words // 8):
            both = chosen.filter(some).filter("own").drop("own").join(chosen.select("token", F.col("at").alias("ref_at")), "token").filter("at > ref_at").select("at", "ref_at").distinct()
            found = both.join(spots.select("at", "doc_id", "pos", "size"), "at")
            found = found.join(spots.select(F.col("at").alias("ref_at"), F.col("doc_id").alias("ref_id"), F.col("pos").alias("ref_pos")), "ref_at")
            yield found.filter("doc_id > ref_id").select("doc_id", "pos", "ref_id", "ref_pos", "size")
        discard(chosen)
    discard(spots, words)


_PASSAGES = "array<struct<begin:int,end:int,ref_begin:int,ref_end:int,identity:double>>"


def _aligned() -> object:
    @F.arrow_udf(_PASSAGES)
    def aligned(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("begin", "end", "ref_begin", "ref_end")] + [("identity", pa.float64())]))
        for arrays in batches:
            rows = list(zip(*(c.to_pylist() for c in arrays), strict=True))
            pairs = [(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), [i - a0 for i in x], [i - b0 for i in y]) for a, b, x, y, a0, b0 in rows]
            out = []
            for (*_, a0, b0), found in zip(rows, align(pairs), strict=True):
                out.append([{"begin": p + a0, "end": q + a0, "ref_begin": r + b0, "ref_end": s + b0, "identity": t} for p, q, r, s, t in found])
            yield pa.array(out, kind)

    return aligned


def _first(small: bool) -> tuple[Column, Column, Column]:
    """The least (doc_id, pos) of a group, and both of it from a column ``ref``; as one number, which is hashed instead of sorted, if ids are small."""
    if small:
        place = F.shiftleft("doc_id", 31).bitwiseOR(F.col("pos").cast("long"))
        return F.min(place), F.shiftright("ref", 31), F.col("ref").bitwiseAND(F.lit(2**31 - 1)).cast("int")
    return F.min(F.struct("doc_id", "pos")), F.col("ref.doc_id"), F.col("ref.pos")


def _keyed(read: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """If an id has several texts: a key for each text, in the order of the ids, instead of its id, and (key, doc_id, digest)."""
    texts = read.filter("seed IS NULL").select("doc_id", "digest")
    if texts.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least < most").isEmpty():
        return read, None
    keys, _ = _stored(texts.distinct().orderBy("doc_id", "digest").withColumn("key", F.monotonically_increasing_id()), "text-keys")
    keyed, _ = _stored(read.join(keys, ["doc_id", "digest"]).select(*[F.col("key").alias(c) if c == "doc_id" else c for c in read.columns]), "seeds")
    discard(read)
    return keyed, keys


def _chains_of(matches: DataFrame) -> tuple[DataFrame, int]:
    """The matches (doc_id, ref_id, pos, ref_pos, size, whole) of each two documents, chained and stored; how many chains that are."""
    pair = ["doc_id", "ref_id", "pos", "ref_pos"]
    # a pair's matches are at most the document's seeds: no group grows with the corpus
    found = matches.select(*pair, "size", "whole").repartition("doc_id", "ref_id").sortWithinPartitions(*pair).mapInArrow(_chained, _CHAINED)
    chain = F.xxhash64("doc_id", "ref_id", F.col("x")[0], F.col("y")[0], F.size("x"))
    found, seen = _stored(found.withColumn("chain", chain), "chains", n=F.count("*"))
    return found, seen["n"]


def _cut_around(found: DataFrame, n_chains: int, marks: DataFrame, bytes_only: DataFrame, n_words: int, spans: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The words around chains that may be long enough, and those of ``spans``, stored; how many chains are left."""

    def around(chained: DataFrame, own: str, first: str, last: str, name: str) -> DataFrame:
        """With the marks, one byte each, before the first match and from the last one on."""
        before = F.least(F.col(first), F.lit(REACH))
        ends = (F.substring("marks", F.col(first) - before + 1, before).alias(f"{name}_left"), F.substring("marks", F.col(last) + 1, F.lit(REACH + K)).alias(f"{name}_right"))
        rest = [c for c in chained.columns if c not in (own, first, last)]
        return chained.join(bytes_only.withColumnRenamed("doc_id", own), own).select(*rest, *ends)

    last = lambda c: F.element_at(c, -1)
    ends = lambda fuzzy: fuzzy.select("chain", (last("x") - F.col("x")[0]).alias("words"), "doc_id", "ref_id", F.col("x")[0].alias("x0"), last("x").alias("x1"), F.col("y")[0].alias("y0"), last("y").alias("y1"))

    def near(fuzzy: DataFrame) -> DataFrame:
        kept = around(around(ends(fuzzy), "doc_id", "x0", "x1", "a"), "ref_id", "y0", "y1", "b").mapInArrow(_long_enough, "chain bigint").distinct()
        return fuzzy.join(kept, "chain", "left_semi")

    fuzzy = store_parts((near(found.filter("NOT whole").filter(part)) for part in _parts("chain", n_chains, n_words // 40)), "near-chains", codec="zstd")

    def sides(own: str, marks: str, role: int, pair: Column) -> DataFrame:
        begin = F.greatest(F.col(marks)[0] - REACH, F.lit(0))
        return fuzzy.select(
            "chain",
            F.lit(role).alias("role"),
            F.col(own).alias("doc_id"),
            begin.alias("begin"),
            (F.element_at(marks, -1) + K + REACH - begin).alias("length"),
            pair.cast("struct<doc_id:bigint,ref_id:bigint,x:array<int>,y:array<int>>").alias("pair"),
        )

    wanted = sides("doc_id", "x", 0, F.struct("doc_id", "ref_id", "x", "y")).unionByName(sides("ref_id", "y", 1, F.lit(None)))
    if spans is not None:
        wanted = wanted.unionByName(spans.select(F.lit(None).cast("long").alias("chain"), F.lit(2).alias("role"), "*", F.lit(None).alias("pair")))
    part = F.substring("marks", F.col("begin") * 4 + 1, F.col("length") * 4)
    cut, seen = _stored(
        marks.join(wanted, "doc_id").select("doc_id", "chain", "role", F.struct("begin", part.alias("part"), "pair").alias("side")), "cut", n=F.count_if(F.col("role") == 0)
    )
    discard(fuzzy)
    return cut, seen["n"]


def _aligned_passages(cut: DataFrame, n_chains: int, n_words: int) -> DataFrame:
    """The passages of chains whose words were cut out, stored."""
    return store_parts((_aligned_part(cut.filter(part)) for part in _parts("chain", n_chains, n_words // 100)), "aligned", codec="zstd")


def _aligned_part(cut: DataFrame) -> DataFrame:
    side = lambda role: F.max(F.when(F.col("role") == role, F.col("side")))
    both = cut.filter("role < 2").groupBy("chain").agg(side(0).alias("a"), side(1).alias("b"))
    passage = F.explode(_aligned()("a.part", "b.part", "a.pair.x", "a.pair.y", "a.begin", "b.begin"))
    passages = both.select("a.pair.doc_id", "a.pair.ref_id", passage.alias("p"))
    return passages.select("doc_id", "p.begin", "p.end", "ref_id", "p.ref_begin", "p.ref_end", "p.identity")


def _outside(passages: DataFrame, known: DataFrame) -> DataFrame:
    """Those that no known passage of the same documents holds."""
    old = known.select(*[F.col(c).alias(f"_{c}") for c in known.columns if c != "identity"])
    inside = "doc_id = _doc_id AND ref_id = _ref_id AND _begin <= begin AND end <= _end AND _ref_begin <= ref_begin AND ref_end <= _ref_end"
    return passages.join(old, F.expr(inside), "left_anti")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", by_text: bool = False) -> DataFrame:
    """``doc_id``, ``begin``, ``end``, ``ref_id``, ``ref_begin``, ``ref_end``, ``identity``.

    Words [begin, end) of the document repeat words [ref_begin, ref_end) of ``ref_id``,
    which has the smaller id. A passage that many documents have is tied to the first of
    them in each. With ``by_text`` a column ``digest`` says which text of the document is meant, by its
    xxhash64; it is NULL where no id has several texts.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    read = texts.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(
        _seed_rows, "seed bigint, nth int, doc_id bigint, pos int, size int, digest bigint, marks binary, near binary"
    )
    read, seen = _stored(read, "seeds", seeds=F.count("seed"), size=F.sum(F.octet_length("marks")))
    n_words = (seen["size"] or 0) // 4
    read, keys = _keyed(read)
    ids = read.filter("seed IS NULL").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    least, ref_id, ref_pos = _first(ids.least is None or (ids.least >= 0 and ids.most < 2**32))
    rows = read.filter("seed IS NOT NULL").drop("marks", "near")

    def shared_rows() -> Iterator[DataFrame]:
        for part in _parts("seed", seen["seeds"], n_words // 12):
            some = rows.filter(part)
            shared = some.groupBy("seed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("seed")
            shared, _ = _stored(shared, "shared-seeds")  # stored, so that a frequent seed is split in the joins like any skewed key
            release(docs.sparkSession)
            yield some.join(shared, "seed", "left_semi")
            discard(shared)

    rows = store_parts(shared_rows(), "shared-rows", codec="zstd")
    texts, _ = _stored(read.filter("seed IS NULL").select("doc_id", "marks", "near"), "marks")  # the other seeds needn't stay
    discard(read)
    marks, bytes_only = (texts.select("doc_id", F.col(c).alias("marks")) for c in ("marks", "near"))
    spans = rows.select("doc_id", "pos", "size").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    spans_stored, _ = _stored(spans.mapInArrow(_by_document(_spans, ["doc_id", "begin", "length"]), "doc_id bigint, begin int, length int"), "spans")
    release(docs.sparkSession)
    first = rows.groupBy("seed", "nth").agg(least.alias("ref"), F.max("doc_id").alias("last"), F.min_by("digest", "doc_id").alias("ref_digest"))
    first = first.filter(F.col("last") > ref_id).select("seed", "nth", ref_id.alias("ref_id"), ref_pos.alias("ref_pos"), "ref_digest")
    first, _ = _stored(first, "first-seeds")
    release(docs.sparkSession)
    nth = F.explode(F.array_distinct(F.array("nth", F.lit(1)))).alias("nth")
    matches = rows.select("seed", "doc_id", "pos", "size", "digest", nth).join(first, ["seed", "nth"]).filter("doc_id > ref_id")
    found, n_chains = _chains_of(matches.withColumn("whole", F.col("digest") == F.col("ref_digest")))
    discard(first)
    cut, n_near = _cut_around(found, n_chains, marks, bytes_only, n_words, spans_stored)
    exact, _ = _stored(found.filter("whole").select("doc_id", "ref_id", F.col("x")[1].alias("size")), "whole")
    discard(found, spans_stored)
    exact = exact.select(
        "doc_id", F.lit(0).alias("begin"), F.col("size").alias("end"), "ref_id", F.lit(0).alias("ref_begin"), F.col("size").alias("ref_end"), F.lit(1.0).alias("identity")
    )
    aligned = _aligned_passages(cut, n_near, n_words)
    chained, _ = _stored(exact.unionByName(aligned).distinct(), "chained")
    runs, seen_runs = _stored(
        cut.filter("role = 2").select("doc_id", "side.begin", "side.part").mapInArrow(_run_rows, "run bigint, doc_id bigint, pos int"), "runs", n=F.count("*")
    )
    discard(cut, aligned)

    def equal_runs() -> Iterator[DataFrame]:
        for part in _parts("run", seen_runs["n"], n_words // 16):
            some = runs.filter(part)
            earliest = some.groupBy("run").agg(least.alias("ref"), F.max("doc_id").alias("last")).filter(F.col("last") > ref_id)
            earliest, _ = _stored(earliest.select("run", ref_id.alias("ref_id"), ref_pos.alias("ref_pos")), "first-runs")
            release(docs.sparkSession)
            yield some.join(earliest, "run").filter("doc_id > ref_id").select("doc_id", "ref_id", (F.col("ref_pos") - F.col("pos")).alias("shift"), "pos")
            discard(earliest)

    equal = store_parts(equal_runs(), "equal-runs", codec="zstd")
    discard(runs)
    kinds = {f.name: f.dataType.simpleString() for f in chained.schema}
    verbatim = equal.repartition("doc_id").sortWithinPartitions("doc_id", "ref_id", "shift", "pos")
    verbatim = verbatim.mapInArrow(_by_document(_joined_runs, list(kinds)), ", ".join(f"{n} {t}" for n, t in kinds.items()))
    passages, _ = _stored(chained.unionByName(_outside(verbatim, chained)), "passages")
    discard(equal, chained)
    # what the first occurrences have left
    others = _other_places(rows, passages, marks, n_words)
    discard(rows)
    found, n_chains = _chains_of(others.withColumn("whole", F.lit(False)))
    discard(others)
    cut, n_near = _cut_around(found, n_chains, marks, bytes_only, n_words)
    discard(texts, found)
    aligned = _aligned_passages(cut, n_near, n_words)
    discard(cut)
    others = _outside(aligned.distinct(), passages)
    passages, _ = _stored(passages.unionByName(others), "passages")
    discard(aligned)
    digest = [F.lit(None).cast("long").alias("digest")] if by_text else []
    if keys is None:
        return passages.select("*", *digest)
    digest = ["digest"] if by_text else []
    own, other = keys.withColumnRenamed("doc_id", "_own"), keys.select(F.col("key").alias("ref_id"), F.col("doc_id").alias("_other"))
    named = passages.withColumnRenamed("doc_id", "key").join(own, "key").join(other, "ref_id").filter("_own > _other")
    return named.select(*[F.col({"doc_id": "_own", "ref_id": "_other"}.get(c, c)).alias(c) for c in passages.columns], *digest)


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, cuts in zip(texts, spans, strict=True):
        gone = np.zeros(len(text) + 1, bool)
        for cut in cuts:
            gone[cut["begin"] : cut["end"]] = True
        # the white space after a word goes with it
        places = enumerate(re.finditer(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", text))
        lead = re.match(r"[ \t\n\x0b\f\r]*", text).group()
        out.append(lead + "".join(m.group() for i, m in places if not gone[i]))
    return pd.Series(out)


def remove_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words that repeat an earlier document; rows and other columns stay.

    Passages with a ``digest`` are cut only from the text that has it: an id may have several texts.
    """
    own, cuts, hashed = (free_name(name, docs) for name in ("_id", "_spans", "_digest"))
    digest = F.col("digest") if "digest" in passages.columns else F.lit(None).cast("long")
    spans = passages.groupBy(F.col("doc_id").alias(own), digest.alias(hashed)).agg(F.collect_list(F.struct("begin", "end")).alias(cuts))
    meant = F.col(hashed).isNull() | (F.col(hashed) == F.xxhash64(text))
    joined = docs.join(spans, (F.col(doc_id).cast("long") == F.col(own)) & meant, "left")
    none = F.array().cast("array<struct<begin:int,end:int>>")
    cut = F.when(F.col(cuts).isNotNull() & F.col(text).isNotNull(), _without(F.coalesce(text, F.lit("")), F.coalesce(cuts, none)))
    return joined.select(*[F.coalesce(cut, F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns])
