"""Token counts of a byte-level BPE vocabulary, without identifiers.

The JVM splits texts into words by the vocabulary's pattern. Per batch only the distinct
words are merged: a heap holds the adjacent pairs, the lowest rank is popped again and
again, neighbours are kept in a linked list. A word's count is its bytes minus its merges.

Cases: NULL counts as the empty text (0 tokens). A special string inside a text is one
token, as the vocabulary's library does by default, and splits the text. Repeated rows
are counted one by one. Words of any length are merged whole, in n log n.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from re import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that byte-level vocabularies of this family split texts by.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def merges_left(symbols: list, ranks: dict) -> list:
    """``symbols`` after all merges; ``ranks`` has (rank, merged symbol) of a pair (left, right)."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*found, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
    heap = [(rank, i, left, right, merged) for rank, merged, i, left, right in heap]
    heapify(heap)
    while heap:
        _, i, left, right, merged = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = merged, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if found := ranks.get((merged, symbols[k])):
                heappush(heap, (found[0], i, merged, symbols[k], found[1]))
        if (h := before[i]) >= 0 and (found := ranks.get((symbols[h], merged))):
            heappush(heap, (found[0], h, symbols[h], merged, found[1]))
    return [s for s in symbols if s is not None]


class WordCounts(dict):
    """Tokens of a word, merged on first use."""

    def __init__(self, vocabulary: str):
        merges = json.loads(vocabulary)["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {pair: (rank, pair[0] + pair[1]) for rank, pair in enumerate(pairs)}
        self.letters = byte_letters()

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = len(merges_left([self.letters[b] for b in word.encode()], self.ranks))
        if len(word) <= 64:
            self[word] = count
        return count


@lru_cache(maxsize=2)
def _word_counts(vocabulary: str) -> WordCounts:
    return WordCounts(vocabulary)


def _any_of(specials) -> str:
    return "|".join(escape(s) for s in sorted(specials, key=len, reverse=True))


def words(text: str | Column, specials: list[str] = ()) -> Column:
    """All words of a text in order, the text being cut at special strings first."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if not specials:
        return F.regexp_extract_all(column, F.lit(WORDS), F.lit(0))
    parts = F.split(column, _any_of(specials))
    return F.flatten(F.transform(parts, lambda part: F.regexp_extract_all(part, F.lit(WORDS), F.lit(0))))


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    The vocabulary file is read by the driver and broadcast: its size is fixed.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    specials = [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _word_counts(shared.value)
        for lists in batches:
            coded = lists.flatten().dictionary_encode()
            each = np.fromiter((known[w] for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            yield pa.array(sums[ends[1:]] - sums[ends[:-1]])

    whole = F.coalesce(F.col(text), F.lit(""))
    columns = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    cut = F.size(F.split(whole, _any_of(specials))) - 1 if specials else F.lit(0)
    return docs.select(
        *columns,
        F.octet_length(whole).cast("long").alias("n_bytes"),
        (counted(words(whole, specials)) + cut).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
