"""Benchmark decontamination by templates.

A text becomes a sequence of tokens in which numbers, names and units are typed
placeholders; everything else is lower-cased and stripped of punctuation. Windows of
``WINDOW`` tokens, at least ``LITERALS`` of them words, are hashed and joined with the
windows of the benchmark's items. A match carries the values in its placeholders: within
an occurrence of an item, every value of the item must be replaced by one and the same
value throughout. A re-parameterised question passes, a chance meeting does not.

A document is contaminated by an item if an occurrence matches at least ``COVERAGE`` of the
item's windows, or ``RUN`` of them, with consistent values. Occurrences are the matches at one
distance between document and item, those between two places where the item begins anew, and
all matches of the document, so neither other versions nor inserted words hide a copy.

All windows are hashed a second time, with their lower-cased words as they are, so copies match
that have too few plain words or are written in capitals.

Only windows whose hash the benchmark has are joined. For that the hashes are broadcast if the
benchmark has at most ``SENT_WINDOWS`` windows (the count is taken first); a larger
benchmark is joined with all windows of the documents instead, with the same result.

Cases: NULL, empty and wordless texts and rows without an id match nothing. An item of
fewer than ``WINDOW`` tokens is one window of its own length. Without enough words only verbatim copies
match. Repeated items and documents are counted once. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from assay.llm.common import free_name
from assay.llm.substring_dedup import words_of
from assay.plans.storing import store

WINDOW, LITERALS = 8, 5
COVERAGE, RUN = 0.5, 8
SENT_WINDOWS = 2_000_000
#: Words taken as units, and words taken as numbers.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces lb "
    "lbs pound pounds ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day "
    "days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees meter meters metre "
    "metres kilometer kilometers kilometre kilometres mph kmh".split()
)
NUMBERS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(st|nd|rd|th)?[%€$£]?")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_WORD, _NUM, _UNIT, _NAME = 0, 1, 2, 3
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def token(raw: str) -> tuple[int, bool, bool, str]:
    """(kind, whether it would be a name inside a sentence, whether it ends a sentence, canonical value) of a word."""
    core = _EDGES.sub("", raw)
    low = core.lower()
    closes = raw.rstrip("\"')]}»”’").endswith((".", "!", "?", ":", ";", "|"))
    if core and _NUMBER.fullmatch(core) or low in NUMBERS:
        return _NUM, False, closes, low
    if low in UNITS:
        return _UNIT, False, closes, low
    return _WORD, core[:1].isupper(), closes, low


def _tokens(lists: pa.Array):
    """(kind, hash of the template token, value index, values, sizes, hash of the value) of all words of a batch that have a value."""
    coded = lists.flatten().dictionary_encode()
    facts = [token(w) for w in coded.dictionary.to_pylist()]
    used = coded.indices.to_numpy()
    kind, name, closes = (np.array([f[i] for f in facts], t)[used] for i, t in ((0, np.int8), (1, bool), (2, bool)))
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.ones(len(used), bool)
    begins[1:] = closes[:-1] | (text[1:] != text[:-1])
    kind = np.where(name & ~begins, _NAME, kind)
    own = np.array([xxh64_intdigest(f[3]) for f in facts], np.uint64)[used]
    hashed = np.where(kind == _WORD, own, kind.astype(np.uint64))
    some = np.array([f[3] != "" for f in facts], bool)[used]
    return kind[some], hashed[some], used[some], [f[3] for f in facts], np.bincount(text[some], minlength=len(sizes)), own[some]


def _windows(kind: np.ndarray, hashed: np.ndarray, sizes: np.ndarray, width: int, exact: bool):
    """(number of the text, first token, hash) of the windows of ``width`` tokens: all if ``exact``, or those that have enough words."""
    counts = np.maximum(sizes - width + 1, 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(len(text)) + np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(counts) - counts), counts)
    words = np.concatenate([[0], np.cumsum(kind == _WORD)])
    good = (words[first + width] - words[first] >= min(LITERALS, width)) | exact
    text, first = text[good], first[good]
    rolled = np.full(len(first), np.uint64(width + (exact << 32)))
    for i in range(width):
        rolled = (rolled ^ hashed[first + i]) * _FACTOR
        rolled ^= rolled >> np.uint64(29)
    return text, first, rolled.view(np.int64)


_FOUND = "id bigint, part bigint, pos int, n_windows int, slots array<string>, exact boolean"


def _reader(widths: list[int], sent=None, items: bool = False):
    """Windows of texts as rows; of documents only those whose hash is in ``sent``, if given."""

    def read(batches):
        known = sent.value if sent is not None else None
        for batch in batches:
            kind, hashed, used, values, sizes, own = _tokens(batch.column(1))
            starts = np.cumsum(sizes) - sizes
            for width, exact in product(widths, (False, True)):
                of = np.where((sizes == width) | (width == WINDOW), sizes, 0) if items else sizes
                text, first, found = _windows(kind, own if exact else hashed, sizes, width, exact)
                if items and width != WINDOW:
                    text, first, found = (v[of[text] == width] for v in (text, first, found))
                n = np.bincount(text, minlength=len(sizes))
                if known is not None:
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    hit = known[at] == found
                    text, first, found = text[hit], first[hit], found[hit]
                for cut in range(0, len(text), 50_000):
                    t, f, h = (v[cut : cut + 50_000] for v in (text, first, found))
                    inside = f[:, None] + np.arange(width)
                    slot = (kind[inside] != _WORD) & (not exact)  # values that are the same need no comparison
                    taken = pa.array([values[i] for i in used[inside[slot]]], pa.string())
                    bounds = np.concatenate([[0], np.cumsum(slot.sum(1))])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": batch.column(0).take(pa.array(t)),
                            "part": pa.array(h),
                            "pos": pa.array((f - starts[t]).astype(np.int32)),
                            "n_windows": pa.array(n[t].astype(np.int32)),
                            "slots": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), taken),
                            "exact": pa.array(np.full(len(t), exact)),
                        }
                    )

    return read


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").select("id", words_of("text").alias("words"))


def _short_items(batches):
    for batch in batches:
        sizes = _tokens(batch.column(1))[4]
        yield pa.RecordBatch.from_pydict({"n": pa.array(np.unique(np.minimum(sizes, WINDOW)), pa.int32())})


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", sent_windows: int = SENT_WINDOWS) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows`` matched, ``coverage`` of the item's windows, ``same_values``.

    One row per document and item that contaminates it; ``same_values`` is false for a
    re-parameterised copy.
    """
    context = docs.sparkSession.sparkContext
    texts = _texts(items, item_id, text)
    lengths = texts.mapInArrow(_short_items, "n int").distinct().collect()  # at most WINDOW + 1 numbers
    widths = sorted({WINDOW} | {row.n for row in lengths if row.n})
    theirs, _ = store(texts.mapInArrow(_reader(widths, items=True), _FOUND), "benchmark-windows")
    theirs = theirs.select("part", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("n_windows").alias("item_windows"), F.col("slots").alias("item_slots"), "exact")
    parts = theirs.select("part").distinct()
    sent = None
    if parts.count() <= sent_windows:
        known = np.sort(parts.toArrow()["part"].to_numpy())
        sent = context.broadcast(known if len(known) else np.array([0], np.int64))
    ours = _texts(docs, doc_id, text).mapInArrow(_reader(widths, sent), _FOUND)
    ours = ours.select("part", F.col("id").alias("doc_id"), "pos", "slots")
    if sent is not None:
        ours, _ = store(ours, "benchmark-hits")
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    joined = ours.join(theirs, "part").select("doc_id", "item_id", "pos", "item_pos", "item_windows", "exact", pairs.alias("pairs"))
    in_order = Window.partitionBy("doc_id", "item_id").orderBy("pos", "item_pos")
    last, last_pos = F.lag("item_pos").over(in_order), F.lag("pos").over(in_order)
    anew = F.coalesce((F.col("item_pos") < last) | ((F.col("item_pos") == last) & (F.col("pos") > last_pos)), F.lit(False))
    joined = joined.withColumn("anew", anew.cast("int")).withColumn("round", F.sum("anew").over(in_order))
    kinds = [("distance", F.col("pos") - F.col("item_pos")), ("round", F.col("round").cast("int")), ("all", F.lit(0))]
    occurrence = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), number.alias("number")) for kind, number in kinds]))
    grouped = joined.withColumn("occurrence", occurrence).groupBy("doc_id", "item_id", "occurrence").agg(
        F.countDistinct("item_pos").alias("n_windows"),
        F.countDistinct(F.when(~F.col("exact"), F.col("item_pos"))).alias("n_templates"),
        F.max(F.when(~F.col("exact"), F.col("item_windows"))).alias("templates"),
        F.max(F.when(F.col("exact"), F.col("item_windows"))).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    coverage = F.greatest(F.col("n_templates") / F.col("templates"), F.col("n_windows") / F.col("windows"))
    passed = grouped.filter(consistent & ((coverage >= COVERAGE) | (F.col("n_windows") >= RUN)))
    best = F.max(F.struct("n_windows", coverage.alias("coverage"), F.forall("pairs", lambda p: p["a"] == p["b"]).alias("same_values")))
    return passed.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones."""
    own = free_name("_id", docs)
    found = contaminated(docs, items, doc_id, text=text).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.col(doc_id).cast("long") == F.col(own), "left_anti")
