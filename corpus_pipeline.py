"""The corpus pipeline: documents to packed training sequences, five stages, each one operator of gridloom.llm.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes what a stage returns as Parquet to the
shared folder and reads it back as the next one's documents; all stages but the last return the columns of documents.

1. quality    importance resampling; documents below the calibrated cut go
2. near_dups  n-gram Jaccard join; of each group the row with the smallest doc_id stays (null ids last, equal ids: the first row)
3. pii        private strings are replaced by surrogates; n_chars follows the text
4. mixing     sources to their target shares; a document comes as often as the mix takes it
5. packing    token ids into sequences of 2048; one row per piece, as in query op6

No stage takes a part of its input only. Stage 2 numbers the rows, so rows with a null or repeated doc_id are compared
like others; rows with null columns stay; columns beyond those of documents pass through all stages but the last, whatever
their names; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import importance, jaccard_join, mixing, packing, pii
from gridloom.llm.queries import tokenizer
from gridloom.llm.storage import discard, free, materialize, read_table

#: rows of groups fewer than this are broadcast (some 10 MB), else joined by a shuffle
BROADCAST_ROWS = 400_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = importance.classify(docs, read_table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return judged.where(F.col(f"`{judged.columns[-1]}`")).select(*_all(docs))


def _all(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free(docs.columns, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "near-dups-rows")
    groups = jaccard_join.link_documents(rows.select(F.col(row).alias("doc_id"), "text"))
    copies = materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_row"), "component_id"), "near-dups-copies")
    members = materialize(copies.unionByName(copies.select(F.col("component_id").alias("_row"), "component_id").distinct()), "near-dups-members")
    named = materialize(rows.select(F.col(row).alias("_row"), "doc_id").join(_small(members), "_row"), "near-dups-named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row"))
    going = materialize(named.join(first, "_row", "left_anti").select(F.col("_row").alias(row)), "near-dups")
    return rows.join(_small(going), row, "left_anti").select(*_all(docs))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(docs)
    replaced = F.col(f"`{done.columns[-1]}`")
    return done.withColumn("n_chars", F.when(F.size(replaced) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*_all(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, read_table(spark, sf_dir, "labels"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=1, cache_pieces=300_000)  # after four stages an executor has less room


STAGES = [("quality", quality), ("near_dups", near_dups), ("pii", private_data), ("mixing", mixture), ("packing", sequences)]

#: the stages train models and tokenize: SQL can't express them; a test holds each against a plain recomputation on the smallest tables
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return docs
