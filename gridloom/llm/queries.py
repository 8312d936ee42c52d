"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, chat, importance, ivfpq, jaccard_join, mixing, neardup_vectors, packing, pii, tokenstore
from .storage import read_table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file: the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.link_vectors(read_table(spark, sf_dir, "embeddings"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"))


def op3_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.self_search(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(read_table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4) + F.lit(0.0))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(read_table(spark, sf_dir, "conversations"))


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=1)


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read_table(spark, sf_dir, "documents"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.roundtrip(spark, read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), spaced=False, end_id=2)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_pii_surrogates, op3_ivf_pq_search, op4_stupid_backoff, op5_chat_formatting, op6_cost_balanced_packing, op7_importance_resampling, op8_ngram_jaccard_join, op9_token_shards, op10_source_mixing)}
ORACLE = {"op1_embedding_near_dedup": neardup_vectors.ORACLE, "op4_stupid_backoff": backoff.ORACLE, "op5_chat_formatting": chat.ORACLE, "op8_ngram_jaccard_join": jaccard_join.ORACLE, "op10_source_mixing": mixing.ORACLE}
