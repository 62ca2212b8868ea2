"""A corpus pipeline: filter by quality, remove near duplicates and benchmark text,
mix the sources, and shard the result.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return rows of ``docs`` with the columns they came with, whatever further columns there are.
A stage is run on what the stage before it wrote. Null and empty texts, null ids, ties,
repeated rows and empty tables are as the operators define them: a text without words scores
by the constant weight of the classifier, is no near duplicate and holds no item; rows
without doc_id are kept by the middle stages; repeated rows stay as often as they are; an
empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliomine.llm import decontamination, mixing, near_duplicates, quality, sharding
from foliomine.llm.scratch import drop, shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_quality(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    return near_duplicates.drop_near_duplicates(docs, n=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_contaminated(docs, items, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of rare sources up to twice."""
    return mixing.mix_documents(docs, mixing.Target(entropy=0.95, max_repeats=2.0))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, law, shard, slot``."""
    return sharding.shard_documents(docs, n_shards=40).drop("grown_shard")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# A trained classifier and iterative assignments are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet and read again. What a stage
    has read is deleted when its own rows are written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop(spark, before)
        before = f"{folder}/{name}"
    return docs
