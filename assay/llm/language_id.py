"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes one space, on the JVM. Every
n-gram of one to four characters, with a space on either side of a word, is hashed into a
bucket. Training sums the buckets per language over all labelled rows; the result, a
matrix of ``buckets`` x languages, does not grow with the corpus and is broadcast.

Cases: a NULL, empty or letterless text is ``und`` with score 0. NULL languages and NULL
texts are not learned from. Repeated rows are scored one by one. Without any labelled
row every text is ``und``. Equal scores go to the language that sorts first. Texts of any
length are read whole, in overlapping pieces. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.common import free_name, in_pieces

ORDERS = 4
BUCKET_BITS = 16
PIECE = 1 << 19
UNKNOWN = "und"
_SPACE = 32


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities: ``weights`` has a row per bucket and a column per language, ``priors`` one per language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    priors: np.ndarray


def letters(text: str | Column) -> Column:
    """The text's words in lower case, parted by single spaces; empty if it has no letter."""
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{M}]+", " "))
    return F.when(column.rlike(r"\p{L}"), words).otherwise("")


def gram_buckets(texts, orders=range(1, ORDERS + 1), bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of every n-gram, a piece and an order at a time."""
    shift = np.uint32(32 - bits)
    for pieces in in_pieces(texts, PIECE, orders[-1] - 1):
        codes = np.frombuffer((" " + " ".join(p for _, p, _, _ in pieces) + " ").encode("utf-32-le"), np.uint32)
        owner = np.repeat([n for n, _, _, _ in pieces], [len(p) + 1 for _, p, _, _ in pieces]).astype(np.int32)
        owner = np.concatenate([np.array([-1], np.int32), owner])
        at = 1
        for _, piece, lead, ends in pieces:
            owner[at : at + lead] = -1
            at += len(piece) + 1
            if not ends:  # no word ends where a text is cut
                owner[at - 1] = -1
        letter = codes != _SPACE
        spread = codes * np.uint32(2654435761) + np.uint32(12345)
        rolled, inner = np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
        for order in range(1, orders[-1] + 1):
            # characters i-order+1 .. i; those between the first and the last are letters
            rolled = rolled[1:] if order > 1 else rolled
            rolled = (rolled ^ spread[: len(rolled)]) * np.uint32(0x9E3779B1) + np.uint32(order)
            first, last = letter[: len(rolled)], letter[order - 1 :]
            if order > 2:
                inner = inner[1:] & letter[1 : 1 + len(rolled)]
            elif order == 2:
                inner = inner[1:]
            if order < orders[0]:
                continue
            good = inner & (owner[order - 1 :] >= 0) & ((first | last) if order > 1 else first)
            mixed = rolled[good]
            yield owner[order - 1 :][good], ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        names = sorted(set(langs))
        place = {name: i for i, name in enumerate(names)}
        for name in langs:
            docs[name] = docs.get(name, 0) + 1
        of = np.array([place[name] for name in langs], np.int64)
        for owner, bucket in gram_buckets(texts):
            counts = np.bincount((of[owner] << BUCKET_BITS) | bucket, minlength=len(names) << BUCKET_BITS)
            for i, name in enumerate(names):
                part = counts[i << BUCKET_BITS : (i + 1) << BUCKET_BITS]
                totals[name] = totals[name] + part if name in totals else part
    for name, counts in totals.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([name] * (len(used) + 1), pa.string()),
                "bucket": pa.array(np.append(used, -1), pa.int32()),
                "n": pa.array(np.append(counts[used], docs[name]), pa.int64()),
            }
        )


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.05) -> LanguageModel:
    """Learn from all rows of ``labelled`` that have a language and a letter.

    Tasks add up their own rows and send one row per language and bucket, so what is
    shuffled and what reaches the driver is bounded by buckets x languages, not by rows.
    """
    rows = labelled.select(letters(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text <> ''")
    counted = rows.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    grams, docs = np.zeros((1 << BUCKET_BITS, len(languages))), np.zeros(len(languages))
    column = table["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy(dtype=float)
    grams[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    docs[column[bucket < 0]] = n[bucket < 0]
    weights = np.log(grams + smoothing) - np.log(grams.sum(0) + smoothing * (1 << BUCKET_BITS))
    return LanguageModel(languages, weights.astype(np.float32), np.log(docs / max(docs.sum(), 1)))


def score_texts(model: LanguageModel, texts) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language and its posterior probability, for texts made by :func:`letters`."""
    likelihood = np.tile(model.priors, (len(texts), 1))
    for owner, bucket in gram_buckets(texts):
        if len(owner):  # owners come in order: each text's n-grams are one run
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            likelihood[owner[starts]] += np.add.reduceat(model.weights[bucket], starts, axis=0, dtype=np.float64)
    best = likelihood.argmax(1)
    top = likelihood[np.arange(len(best)), best]
    return best, 1 / np.exp(likelihood - top[:, None]).sum(1)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for texts in batches:
            some = (texts.to_numpy() != "") & (len(known.languages) > 0)
            best, score = np.full(len(texts), len(known.languages)), np.zeros(len(texts))
            if some.any():
                best[some], score[some] = score_texts(known, texts[some].tolist())
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    both = free_name("_scored", docs)
    return docs.select(*columns, scored(letters(text)).alias(both)).select(*columns, f"{both}.lang_pred", f"{both}.score")
