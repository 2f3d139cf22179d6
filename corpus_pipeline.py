"""Corpus pipeline: quality rules, toxicity, MinHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared
checkpoint folder and reads it again as the next stage's documents; what came before is then removed. All stages but the last return the columns that they
got. Null, empty and very long texts, repeated rows, empty tables and further columns are handled as the operators'
docstrings state; documents without 50 words, null texts among them, do not pass the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from edgewise.functions.session import checkpoint_dir, remove
from edgewise.llm import neardup, packing, quality, queries, toxicity
from edgewise.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.WORD_LEVEL)


STAGES = [("quality", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("packing", pack_sequences)]

#: Learned scores and confirmed signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
