"""The queries of these operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import (
    alignment,
    byte_bpe,
    cover_tree,
    decontamination,
    embedding_dedup,
    language_id,
    licences,
    prefix_trie,
    quality,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)
from assay.llm.common import bounded_batches, held_out
from assay.plans.shipping import ship_package

QUERIES = {}
SQL: dict[str, str] = {}


def query(build):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        bounded_batches(spark)
        return build(spark, folder)

    QUERIES[build.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    model = language_id.train(docs.filter(~held_out()))
    return language_id.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


@query
def op2_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json")).drop("text")


@query
def op6_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op4_byte_bpe(spark, folder):
    ranks = tokenizer("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), ranks, decoded_as="decoded")
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.btrim(F.to_json("ids"), F.lit("[]")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_embedding_near_dedup(spark, folder):
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query
def op9_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(~held_out()))
    return toxicity.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


@query
def op10_licence_scan(spark, folder):
    return licences.scan(table(spark, folder, "documents"), licences.known_licences(spark))


SQL["op10_licence_scan"] = licences.scan_sql()


@query
def op5_substring_dedup(spark, folder):
    return substring_dedup.repeated_passages(table(spark, folder, "documents"))


@query
def op8_benchmark_decontamination(spark, folder):
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.classify(docs, labels.filter("quality = 1"))


@query
def op11_token_alignment(spark, folder):
    return alignment.align(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op12_top_k_search(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return cover_tree.top_k(cover_tree.stepped(vectors), F.col("vec_id") % 100 == 0)


@query
def op13_prefix_trie(spark, folder):
    turns = prefix_trie.rebuilt(prefix_trie.conversations(table(spark, folder, "conversations")))
    return prefix_trie.trie(turns)
