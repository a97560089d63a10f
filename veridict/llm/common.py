"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII blanks; both forms name the same set.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: A counted table up to this many bytes in memory is sent to all executors, and what a row takes there besides its data.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 100
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder: the cluster's ``spark.checkpoint.dir``; only where none is set (tests) a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veridict-checkpoint-"))
    return context.getCheckpointDir()


def shared(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that a lost executor costs no recomputation of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def files(folder: str):
    """pyarrow's file system of a URI, and the path within it."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written once as a compressed table in the shared folder, and what removes it when nothing needs it more."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)

    def remove() -> None:
        system, at = files(folder)
        system.delete_dir(at)

    return df.sparkSession.read.schema(df.schema).parquet(folder), remove


def measured(few: DataFrame, row_bytes: int) -> DataFrame:
    """``few`` written once and counted; marked to be broadcast if it is small, and joined by a shuffle if it is not."""
    few = shared(few)
    return F.broadcast(few) if few.count() * (row_bytes + ROW_BYTES) <= BROADCAST_BYTES else few


def whole_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text: Column) -> Column:
    """The words in order. Edges are trimmed first, so that the split makes no empty pieces."""
    trimmed = F.trim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def unit_interval(*key: Column) -> Column:
    """A number in (0, 1) fixed by the key, with 53 random bits."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def by_group(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroups batches sorted by ``key`` so that no group is cut: a frame has one or several
    whole groups. Holds one batch and one group at most."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut or (rest and rest[-1][key].iloc[-1] != keys[0]):
            if rest and rest[-1][key].iloc[-1] != keys[0]:
                yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
                rest = []
            if cut:
                head = pd.concat([*rest, batch.iloc[:cut]], ignore_index=True) if rest else batch.iloc[:cut]
                rest = []
                yield head
        rest.append(batch.iloc[cut:])
    if rest:
        yield pd.concat(rest, ignore_index=True)
