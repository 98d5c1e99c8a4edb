"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word's embedding is the mean of the embeddings of its hashed character n-grams (three
to six letters, its two ends marked), so a misspelling never seen shares most of its
vectors with the words it comes from. A linear softmax over the mean of the ``TOP`` words
that say most for class 1 gives the two classes' probabilities: all words of the whole
text are scored and training follows the gradient through the highest, so that a few insults
do not drown in a long text and one chance likeness does not condemn it. N-grams that
fewer than ``LEAST`` examples have are left out.

The classifier is fitted on a bounded sample: ``SAMPLE`` labelled rows of each class at
most, those with the smallest hash of their id, and of these the texts of at most
``SAMPLE_BYTES`` bytes. Scoring has no such bounds.

Cases: NULL, empty and wordless texts score 0. Several labels of a document count as
toxic if one is. Without examples of both classes every text scores 0. Repeated
rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.language_id import gram_buckets

SAMPLE, SAMPLE_BYTES = 1500, 1 << 16
TOP, LEAST = 3, 5
GRAMS, BITS, WIDTH = range(3, 7), 18, 16
EPOCHS, RATE, DECAY = 60, 0.05, 0.3
BALANCE, WARM_UP = 0.3, 10
WORDS_AT_ONCE = 1 << 15


@dataclass(frozen=True)
class ToxicityModel:
    embeddings: np.ndarray  # a row per bucket
    weights: np.ndarray  # a column per class
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What each bucket adds to class 1 over class 0."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])


def words_of(text: str | Column) -> Column:
    column = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    # possessive: a repeated group that may give back recurses in the JVM, once per repeat
    return F.regexp_extract_all(column, F.lit(r"\p{N}*+\p{L}[\p{L}\p{M}\p{N}]*+(?:[*$][\p{L}\p{M}\p{N}]++)*+"), F.lit(0))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, end of each word's run) of all n-grams, in the order of the words."""
    found = list(gram_buckets(words, GRAMS, BITS))
    owner = np.concatenate([o for o, _ in found]) if found else np.zeros(0, np.int32)
    bucket = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.uint32)
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), np.cumsum(np.bincount(owner, minlength=len(words)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def word_margins(margins: np.ndarray, words: list[str]) -> np.ndarray:
    """The mean of what each word's n-grams add to class 1."""
    out = [np.zeros(0)]
    for start in range(0, len(words), WORDS_AT_ONCE):
        bucket, ends = subwords(words[start : start + WORDS_AT_ONCE])
        out.append(_sums(margins[bucket], ends) / np.maximum(np.diff(ends, prepend=0), 1))
    return np.concatenate(out)


def worst_words(scalars: np.ndarray, ends: np.ndarray, top: int | None = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, places, number) of each text's ``top`` highest words, of all words if there are fewer or ``top`` is None."""
    begins = np.concatenate([[0], ends[:-1]])
    sizes = ends - begins
    text = np.repeat(np.arange(len(ends)), sizes)
    if top is None:
        places, n = np.arange(len(text)), sizes
    else:
        order = np.lexsort((-scalars, text))  # equal words in the order of the text
        places, n = order[np.arange(len(text)) - begins[text] < top], np.minimum(sizes, top)
    return np.bincount(text[places], scalars[places], len(ends)) / np.maximum(n, 1), places, n


def _examples(word: np.ndarray, text_sizes: np.ndarray, n_words: int) -> np.ndarray:
    """The number of texts that have each word."""
    text = np.repeat(np.arange(len(text_sizes), dtype=np.int64), text_sizes)
    return np.bincount(np.unique(text * n_words + word) % max(n_words, 1), minlength=n_words)


def fit(word_lists: list[list[str]], toxic: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Full-batch Adam on the cross-entropy; toxic texts weigh ``BALANCE`` of the whole.

    In the first ``WARM_UP`` rounds a text is the mean of all its words, then of its worst.
    """
    drawn = np.random.default_rng(seed)
    embeddings = drawn.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    weights, bias = drawn.normal(0, 1, (WIDTH, 2)).astype(np.float32), np.array([1.0, -1.0], np.float32)
    coded = pa.array([w for ws in word_lists for w in ws], pa.string()).dictionary_encode()
    text_ends = np.cumsum([len(ws) for ws in word_lists])
    text_sizes = np.diff(text_ends, prepend=0)
    bucket, ends = subwords(coded.dictionary.to_pylist())
    index = coded.indices.to_numpy()
    sizes = np.diff(ends, prepend=0)
    used = np.unique(bucket)
    place = np.searchsorted(used, bucket)
    often = np.bincount(place, np.repeat(_examples(index, text_sizes, len(ends)), sizes), len(used))
    common = (often >= LEAST).astype(np.float32)
    embeddings_used = embeddings[used] * common[:, None]
    share = np.where(toxic == 1, BALANCE / max((toxic == 1).sum(), 1), (1 - BALANCE) / max((toxic == 0).sum(), 1))
    parts = [embeddings_used, weights, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    for epoch in range(1, EPOCHS + 1):
        aim = weights[:, 1] - weights[:, 0]
        scalar = _sums((embeddings_used @ aim)[place], ends) / np.maximum(sizes, 1)
        value, places, n = worst_words(scalar[index], text_ends, TOP if epoch > WARM_UP else None)
        chance = 1 / (1 + np.exp(-np.clip(value + bias[1] - bias[0], -500, 500)))
        slope = share * (chance - toxic)
        per_word = np.bincount(index[places], np.repeat(slope / np.maximum(n, 1), n), len(ends)) / np.maximum(sizes, 1)
        pull = np.bincount(place, np.repeat(per_word, sizes), len(used)).astype(np.float32) * common
        down = embeddings_used.T @ pull
        gradients = [np.outer(pull, aim), np.stack([-down, down], 1), np.array([-slope.sum(), slope.sum()])]
        for part, gradient, (mean, square) in zip(parts, gradients, moments, strict=True):
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient * gradient - square)
            part *= 1 - RATE * DECAY
            part -= RATE * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    embeddings[:] = 0  # n-grams that no example has say nothing
    embeddings[used] = embeddings_used
    return ToxicityModel(embeddings, weights, bias)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicityModel | None:
    """Fit on the sample described above; None without both classes."""
    each = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    order = F.xxhash64("doc_id")
    chosen = [each.filter(F.col("label") == value).orderBy(order, "doc_id").limit(SAMPLE) for value in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * SAMPLE rows of two numbers: small enough to broadcast
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .filter(F.octet_length("text") <= SAMPLE_BYTES)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", words_of("text").alias("words"), "label")
        .toArrow()
        .sort_by("doc_id")
    )
    lists, toxic = rows["words"].to_pylist(), rows["label"].to_numpy()
    return fit(lists, toxic) if len(set(toxic)) == 2 else None


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    if model is None:
        scored = F.lit(0.0)
    else:
        # two numbers per bucket at most are sent, however many texts there are
        shared = docs.sparkSession.sparkContext.broadcast((model.margins().astype(np.float32), float(model.bias[1] - model.bias[0])))

        @F.arrow_udf("double")
        def worst(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            margins, bias = shared.value
            for lists in batches:
                coded = lists.flatten().dictionary_encode()
                scalar = word_margins(margins, coded.dictionary.to_pylist())
                text_ends = np.cumsum(pc.list_value_length(lists).to_numpy())
                value, _, n = worst_words(scalar[coded.indices.to_numpy()], text_ends)
                yield pa.array(np.where(n > 0, 1 / (1 + np.exp(-np.clip(value + bias, -500, 500))), 0.0))

        scored = worst(words_of(text))
    return docs.select(*columns, scored.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
