"""From raw documents to token digests: each stage works on all that the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veridict.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from veridict.llm.common import documents, files, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("BPE", encode)]

#: SimHash groups, hash-seeded copies and token ids have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the shared folder and read again, and removed when
    the next one's is there. A table without rows goes through all stages; columns that ``documents`` has besides are kept
    up to the last."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            system, at = files(f"{folder}/{k - 1}")
            system.delete_dir(at)
    return docs
