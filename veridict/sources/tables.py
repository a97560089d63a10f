"""Parquet tables and intermediate results in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """URI of the cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veridict-checkpoint-"))
    return context.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """Written once to the shared folder by ``checkpoint()``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written once to the shared folder as a table. Unlike a checkpoint it carries nothing that the optimiser has
    inferred, which loops would double with each round."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Rows that one row is written out to at a time.
AT_ONCE = 20_000


def stepped(rows: DataFrame, times: str, step: str) -> DataFrame:
    """Each row as often as its column ``times`` says, with ``step`` counting from 1. What stands very often is cut into
    ranges that are dealt out first, so no row is written out by one task alone."""
    few = rows.where(F.col(times) <= AT_ONCE).withColumn(step, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))))
    cut = rows.where(F.col(times) > AT_ONCE).withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"), F.lit(AT_ONCE).cast("long"))))
    last = F.least(F.col("__from") + AT_ONCE - 1, F.col(times))
    many = cut.repartition("__from").withColumn(step, F.explode(F.sequence(F.col("__from"), last))).drop("__from")
    return few.unionByName(many)


def spread(df: DataFrame) -> DataFrame:
    """Dealt evenly to the session's number of shuffle partitions: for work on narrow rows that costs far more than
    moving them, so that few large files or row groups do not mean few tasks. The plan is the same at every size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
