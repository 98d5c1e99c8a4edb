"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of character 4-grams (UTF-16 units, so that a 4-gram is one 64-bit key).
Its counts are aggregations, and the probability of each distinct 4-gram of the corpus, seen in
trusted text or not, comes from joins of the counts and contexts of all four orders.

Scoring joins counts, not positions. A task turns some millions of characters into
(4-gram, document, count), packed per shard of the model, since one row per entry would
be several times the text. Shards hold ``SHARD`` 4-grams at most; each is repeated for
every ``GROUP_BYTES`` of text and meets that share of the packed counts, so a group's
size depends neither on the corpus nor on a frequent 4-gram. What comes back is one sum per
document and shard.

A document is kept up to the perplexity that ``QUANTILE`` of the trusted documents of its
language stay below. These are held out: a fifth of the trusted documents is not counted. A
language without any takes those of all languages; where none is held out, or all are, the
trusted documents are counted and judged alike.

Cases: NULL, empty and blank texts have no perplexity and are not kept. Rows that repeat
an id are one document; rows without an id are left out. Without trusted text nothing is
known and every document with text is kept. A NULL language is a language of its own. Texts of any length are
read whole, in overlapping pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import held_out, in_pieces
from assay.plans.storing import store

ORDER = 4
PIECE = 1 << 21
SHARD = 1_000_000
GROUP_BYTES = 32 << 20
QUANTILE = 0.99
SENT_IDS = 4_000_000
SENT_LANGUAGES = 100_000
_START, _END = "\x02" * (ORDER - 1), "\x03"


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of (4-gram, number of the text): one 4-gram per character, and one for the end."""
    for pieces in in_pieces([t + _END for t in texts], PIECE, ORDER - 1):
        units = [np.frombuffer((_START[lead:] + p).encode("utf-16-le", "surrogatepass"), np.uint16) for _, p, lead, _ in pieces]
        sizes = np.array([len(u) for u in units])
        flat = np.concatenate(units).astype(np.uint64)
        keys = (flat[:-3] << np.uint64(48)) | (flat[1:-2] << np.uint64(32)) | (flat[2:-1] << np.uint64(16)) | flat[3:]
        owner = np.repeat([n for n, _, _, _ in pieces], sizes)[3:]
        inside = np.ones(len(flat), bool)  # the first three units of a piece end no 4-gram of it
        starts = np.cumsum(sizes) - sizes
        for i in range(ORDER - 1):
            inside[starts + i] = False
        yield keys[inside[3:]], owner[inside[3:]]


def _vocabulary(batches):
    """Distinct 4-grams with their counts in trusted text."""
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False)
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for key, owner in grams(batch.column(0).to_pylist()):
            good = trusted[owner]
            own, n = np.unique(key[good], return_counts=True)
            rest = np.unique(key[~good])
            keys, place = np.unique(np.concatenate([keys, own, rest]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n, np.zeros(len(rest))]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(keys.view(np.int64)), "n": pa.array(counts)})


def _discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
    known = all(n)
    y = n[0] / (n[0] + 2 * n[1]) if known else 0.5
    ideal = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]] if known else [0.5, 1.0, 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(ideal)]


def _terms(counts: DataFrame, key: str, context: Column, order: int) -> tuple[DataFrame, DataFrame]:
    """Discounted counts by key, and by context the total and the mass left for the order below."""
    small = _discounts(counts)
    n = F.col("n")
    cut = F.when(n == 1, small[0]).when(n == 2, small[1]).otherwise(small[2])
    seen = counts.select(F.col("gram").alias(key), F.greatest(n - cut, F.lit(0.0)).alias(f"rest{order}"))
    below = counts.groupBy(context.alias(f"context{order}")).agg(F.sum(n).alias(f"total{order}"), F.sum(F.least(cut, n)).alias(f"mass{order}"))
    return seen, below


def probabilities(counts: DataFrame) -> DataFrame:
    """(gram, bits): the negative binary logarithm of each 4-gram's probability after its first three units.

    ``counts`` has all 4-grams with their trusted counts, 0 included.
    """
    gram = F.col("gram")
    suffix = lambda bits: gram.bitwiseAND(F.lit((1 << bits) - 1))
    top = counts.filter("n > 0")
    orders = {4: top}
    for order in (3, 2, 1):  # below the highest order a count is the number of different units before
        lower = orders[order + 1].groupBy(suffix(16 * order).alias("gram")).agg(F.count("*").alias("n"))
        orders[order], _ = store(lower, f"order-{order}")
    scored = counts.select("gram")
    for order in (4, 3, 2):
        key = suffix(16 * order) if order < 4 else gram
        context = F.shiftrightunsigned(key, 16)
        seen, below = _terms(orders[order], f"key{order}", F.shiftrightunsigned("gram", 16), order)
        scored = scored.withColumn(f"k{order}", key).withColumn(f"c{order}", context)
        scored = scored.join(seen, F.col(f"k{order}") == F.col(f"key{order}"), "left").drop(f"key{order}", f"k{order}")
        scored = scored.join(below, F.col(f"c{order}") == F.col(f"context{order}"), "left").drop(f"context{order}", f"c{order}")
    units = orders[1].agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = units.total or 0, units.kinds
    scored = scored.withColumn("unit", suffix(16)).join(orders[1].select(F.col("gram").alias("last"), "n"), F.col("unit") == F.col("last"), "left")
    # 0.75 of each unit's count is kept apart for units never seen
    p = F.greatest(F.coalesce("n", F.lit(0)) - 0.75, F.lit(0.0)) / max(total, 1) + (0.75 * kinds / total if total else 1.0) / (kinds + 1)
    for order in (2, 3, 4):
        mine = (F.coalesce(f"rest{order}", F.lit(0.0)) + F.col(f"mass{order}") * p) / F.col(f"total{order}")
        p = F.when(F.col(f"total{order}").isNotNull(), mine).otherwise(p)
    return scored.select("gram", (-F.log2(p)).alias("bits"))


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(shards)).astype(np.int32)


def _shard(shards: int):
    """The shard of each key, for keys as rows."""

    def add(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_shard_of(keys, shards))], [*batch.schema.names, "shard"])

    return add


_ZSTD = pa.Codec("zstd", 1)


def _packed(values: np.ndarray, kind) -> bytes:
    """Numbers with all their first bytes together, then all second bytes, compressed; small numbers cost little."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _unpacked(packed: bytes, kind) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(_ZSTD.decompress(packed[8:], decompressed_size=size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


_PACKED = "shard int, share int, ids binary, keys binary, sizes binary, owners binary, counts binary"


def _pack(shards: int, shares: int):
    def pack(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for keys, owner in grams(batch.column(1).to_pylist()):
                distinct, place = np.unique(keys, return_inverse=True)
                low = owner.min() if len(owner) else 0
                width = int(owner.max() - low) + 1 if len(owner) else 1
                entry, count = np.unique(place.astype(np.int64) * width + (owner - low), return_counts=True)
                of, doc = entry // width, entry % width
                mine = ids[low : low + width]
                share = int(_shard_of(mine[:1].view(np.uint64), shares)[0]) if len(mine) else 0
                shard = _shard_of(distinct, shards)
                rows = []
                for s in range(shards):
                    chosen = shard[of] == s
                    own, docs = distinct[shard == s], doc[chosen]
                    sizes = np.bincount(of[chosen], minlength=len(distinct))[shard == s]
                    # keys are sorted and so are the documents of a key: differences are small
                    steps = np.diff(own, prepend=np.uint64(0))
                    gaps = np.diff(docs, prepend=0)
                    heads = np.cumsum(sizes) - sizes
                    gaps[heads] = docs[heads]
                    rows.append(
                        (s, share, mine.tobytes(), _packed(steps, np.uint64), _packed(sizes, np.uint32), _packed(gaps, np.uint32), _packed(count[chosen], np.uint32))
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["shard", "share", "ids", "keys", "sizes", "owners", "counts"]).cast(_schema())

    return pack


def _schema():
    return pa.schema([("shard", pa.int32()), ("share", pa.int32()), *((n, pa.binary()) for n in ("ids", "keys", "sizes", "owners", "counts"))])


_SUMS = "doc_id bigint, bits double, n bigint"


def _summed(packed: pa.Table, model: pa.Table) -> pa.Table:
    """Per document of each pack, the sum over its 4-grams in this shard."""
    known, bits = model["gram"].to_numpy().view(np.uint64), model["bits"].to_numpy()
    order = np.argsort(known)
    known, bits = known[order], bits[order]
    out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    for row in range(packed.num_rows):
        ids, keys, sizes, owners, counts = (packed[n][row].as_py() for n in ("ids", "keys", "sizes", "owners", "counts"))
        ids, keys = np.frombuffer(ids, np.int64), np.cumsum(_unpacked(keys, np.uint64), dtype=np.uint64)
        sizes, counts = _unpacked(sizes, np.uint32).astype(np.int64), _unpacked(counts, np.uint32)
        heads = np.cumsum(sizes) - sizes
        run = np.cumsum(_unpacked(owners, np.uint32), dtype=np.int64)
        owners = run - np.repeat(np.concatenate([[0], run])[heads], sizes)
        at = np.searchsorted(known, keys)
        if (at >= len(known)).any() or (known[at] != keys).any():
            raise ValueError("a 4-gram of the documents is missing from the model: the input changed between two reads")
        each = np.repeat(bits[at], sizes)
        out.append((ids, np.bincount(owners, each * counts, len(ids)), np.bincount(owners, counts, len(ids)).astype(np.int64)))
    ids, sums, n = (np.concatenate(v) for v in zip(*out, strict=True))
    return pa.table({"doc_id": ids, "bits": sums, "n": n})


def perplexities(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``perplexity``, ``trusted`` for every document with text; ``trusted`` holds the ids to learn from."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    good = trusted.select(F.col(doc_id).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True))
    good, seen = store(good, "trusted", n=F.count("*"))
    few = F.broadcast(good) if seen["n"] <= SENT_IDS else good  # ids alone: 16 bytes each
    known = F.coalesce("trusted", F.lit(False)).alias("trusted")
    counts = texts.join(few, "doc_id", "left").select("text", known).mapInArrow(_vocabulary, "gram bigint, n bigint")
    counts, size = store(counts.groupBy("gram").agg(F.sum("n").alias("n")), "grams", n=F.count("*"))
    volume = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size["n"] // SHARD))
    shares = max(1, -(-volume // (shards * GROUP_BYTES)))
    model = probabilities(counts).mapInArrow(_shard(shards), "gram bigint, bits double, shard int")
    model = model.select("gram", "bits", "shard", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    packed = texts.mapInArrow(_pack(shards, shares), _PACKED)
    sums = packed.groupBy("shard", "share").cogroup(model.groupBy("shard", "share")).applyInArrow(_summed, _SUMS)
    scores = sums.groupBy("doc_id").agg(F.pow(F.lit(2.0), F.sum("bits") / F.sum("n")).alias("perplexity"))
    return scores.join(good, "doc_id", "left").select("doc_id", "perplexity", known)


def classify(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``lang``, ``perplexity``, ``highest`` that the language allows, ``kept``."""
    out = held_out(doc_id)
    ids = docs.filter(F.col(text).rlike(r"\S")).select(F.col(doc_id).cast("long").alias(doc_id))
    good = trusted.select(F.col(doc_id).cast("long").alias(doc_id)).filter(F.col(doc_id).isNotNull()).distinct().join(ids, doc_id, "left_semi")
    good, seen = store(good, "trusted-texts", n=F.count("*"), out=F.count_if(out))
    split = 0 < seen["out"] < seen["n"]
    learnt = good.filter(~out) if split else good
    judged = (good.filter(out) if split else good).select(F.col(doc_id).alias("doc_id"), F.lit(True).alias("judged"))
    scores, _ = store(perplexities(docs, learnt, doc_id, text).drop("trusted").join(judged, "doc_id", "left"), "perplexities")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang")).filter("doc_id IS NOT NULL")
    rows, _ = store(named.groupBy("doc_id").agg(F.min("lang").alias("lang")).join(scores, "doc_id", "left"), "quality")
    limit = F.percentile_approx(F.when(F.col("judged"), F.col("perplexity")), QUANTILE, 10_000)
    by_language = rows.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(limit.alias("own"))
    by_language, seen = store(by_language, "quality-limits", n=F.count("*"))
    if seen["n"] <= SENT_LANGUAGES:  # a language may have most of the rows: they stay where they are
        by_language = F.broadcast(by_language)
    overall = rows.agg(limit.alias("all"))  # one row
    rows = rows.join(by_language, F.coalesce("lang", F.lit("")) == F.col("of"), "left").join(F.broadcast(overall))
    highest = F.coalesce("own", "all")
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= highest, F.lit(True))
    return rows.select("doc_id", "lang", "perplexity", highest.alias("highest"), kept.alias("kept"))
