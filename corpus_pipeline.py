"""A corpus pipeline: toxic documents go, near copies go, repeated passages go, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioloom.llm import _components as cc
from folioloom.llm.best_fit_packing import best_fit_packing
from folioloom.llm.simhash_near_dedup import keep_one
from folioloom.llm.substring_dedup import without_repeats
from folioloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored 0.7 or more."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 20 words and more that stood earlier; every document stays."""
    return without_repeats(docs)


def best_fit_packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of the packed sequences."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing_)]

#: Learnt scores, fingerprints and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cc.prepare(docs)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.range(1).selectExpr('uuid()').first()[0]}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
