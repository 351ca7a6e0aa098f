"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents. Null texts are empty ones; rows
without a doc_id go through every stage but stand for no group; no rows give no rows; texts of any length are
whole; further columns are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import bpe, decontam, graph, quality, simhash, suffix
from rangeloom.llm.queries import tokenizer_path
from rangeloom.sources.shared import delete_at_exit

#: SQL can't express boosted trees or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; without labels of both kinds, none is told from another."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: 5-word shingles with Jaccard similarity 0.8 or more."""
    return simhash.keep_first(docs, words=5, radius=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that start in an earlier document too."""
    return suffix.trim(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no stretch within a fifth of the words of a benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with checksums of the ids and of what they decode to."""
    return bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True).drop("decoded")


STAGES = [("quality classifier", quality_classifier), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", substring_dedup), ("benchmark decontamination", decontamination), ("BPE encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once the next one is written, the last one when the driver ends."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{graph.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            graph.delete(spark, f"{folder}/{i - 1}")
    return docs
