"""From raw documents to token ids in five stages, each of which works on what the one before kept.

Every stage takes (spark, docs, folder of the given tables); all but the last return the
columns of ``documents``. NULL texts count as empty. An empty table goes through all stages.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import byte_bpe, decontamination, language_id, simhash, substring_dedup
from assay.llm.common import bounded_batches, held_out
from assay.llm.queries import table, tokenizer
from assay.plans.shipping import ship_package
from assay.plans.storing import store

LEAST_SCORE = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


def _stage(build):
    @wraps(build)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bounded_batches(spark)
        return build(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_language(spark, docs, sf_dir):
    """Documents whose language is recognised; those without a letter or of no clear language go."""
    model = language_id.train(docs.filter(~held_out()))
    named = language_id.predict(docs, model)
    return named.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


@_stage
def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each component, the one with the smallest id (NULL last), then the smallest digest of its text.

    Rows are judged one by one: those without an id or with an id that others have, too, stay unless a near copy does.
    """
    return simhash.one_of_each_group(docs)


@_stage
def cut_repeated_passages(spark, docs, sf_dir):
    """All documents, without the passages that repeat a document of smaller id."""
    cut = substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs, by_text=True))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@_stage
def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold no item of the benchmark."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode_texts(spark, docs, sf_dir):
    """Token ids of every text, and whether they decode to it."""
    ids = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer(RANKS), decoded_as="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode_texts),
]

#: Models, components and alignments have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, build in STAGES[:-1]:
        docs, _ = store(build(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
