"""Operator 7: exact deduplication by an exchange of Golomb-coded fingerprints.

Every partition sends its sorted, compressed 64-bit fingerprints to their owners; owners answer with bitmaps that tell
which of them occur elsewhere too; only documents with such a fingerprint are shuffled, and compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm import golomb
from veridict.llm.common import BLANK_RUN, documents, measured, shared, whole_text

#: Fingerprints that a task codes at a time, and that one owner has on average. Both are large, so that a chunk has
#: some for each owner also at 1e11 rows.
CHUNK = PER_OWNER = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_RUN, " ")


def _coded(owners: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk, held, count = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            owner = (found >> np.uint64(32)).astype(np.uint64) * np.uint64(owners) >> np.uint64(32)
            cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
            rows = [(part << 24 | chunk, i, golomb.encode(found[a:b]), np.packbits(times[a:b] > 1).tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            return pd.DataFrame(rows, columns=["chunk", "owner", "code", "repeated"])

        for batch in batches:
            held.append(batch["fingerprint"].to_numpy(np.int64).view(np.uint64))
            count += len(batch)
            if count >= CHUNK:
                yield flush()
                chunk, held, count = chunk + 1, [], 0
        if count:
            yield flush()

    return run


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps of the fingerprints that more than one chunk has sent to this owner."""
    sent = [golomb.decode(code) for code in group["code"]]
    found, times = np.unique(np.concatenate(sent), return_counts=True)
    twice = found[times > 1]
    bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in sent]
    return pd.DataFrame({"chunk": group["chunk"], "owner": group["owner"], "bitmap": bitmaps})


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for code, repeated, bitmap in zip(batch["code"], batch["repeated"], batch["bitmap"]):
            numbers = golomb.decode(code)
            hit = np.unpackbits(np.frombuffer(repeated, np.uint8) | np.frombuffer(bitmap, np.uint8), count=len(numbers))
            found.append(numbers[hit.astype(bool)].view(np.int64))
        yield pd.DataFrame({"fingerprint": np.concatenate(found) if found else np.empty(0, np.int64)})


def suspect_fingerprints(prints: DataFrame, expected_rows: int) -> DataFrame:
    """Distinct fingerprints that two rows or more of ``prints(fingerprint)`` share."""
    owners = max(1, -(-expected_rows // PER_OWNER))
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-expected_rows // CHUNK))
    codes = shared(prints.coalesce(tasks).mapInPandas(_coded(owners), "chunk long, owner int, code binary, repeated binary"))
    answers = codes.select("chunk", "owner", "code").groupBy("owner").applyInPandas(_answer, "chunk long, owner int, bitmap binary")
    return codes.join(answers, ["chunk", "owner"]).mapInPandas(_suspects, "fingerprint long").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, where groups are texts equal up to runs of blanks.

    Null texts are empty ones and form a group with them. Null ids never are the smallest unless all are; rows that
    repeat an id and a text all bear the answer of that document. Other columns are ignored.
    """
    text = normalised(whole_text())
    prints = shared(docs.select("doc_id", F.xxhash64(text).alias("fingerprint"), F.sha2(text, 256).alias("text_sha256")))
    suspects = shared(suspect_fingerprints(prints.select("fingerprint"), prints.count()))
    checked = docs.select("doc_id", text.alias("t")).withColumn("fingerprint", F.xxhash64("t")).join(measured(suspects, 16), "fingerprint", "left_semi")
    # the whole text is the key: bytes are compared, and copies within a partition are summed up before the shuffle
    groups = checked.groupBy("t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.sha2("t", 256).alias("text_sha256"), "keep_id", "n")
    joined = prints.join(groups, "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies; of rows that repeat an id and a text one stays, the first by its JSON form."""
    verdicts = shared(exact_groups(docs).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"))
    same = (F.col("__sha0") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    rows = docs.withColumn("__sha0", F.sha2(normalised(whole_text()), 256))
    gone = verdicts.where(~F.col("kept")).select("__id", "__sha").distinct()
    left = rows.join(measured(gone, 64), same, "left_anti")
    repeated = verdicts.where("kept").groupBy("__id", "__sha").count().where("count > 1").select("__id", "__sha")
    if not repeated.isEmpty():
        whole = F.struct(*docs.columns)
        one = left.join(repeated, same, "left_semi").groupBy("doc_id", "__sha0").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
        return left.join(repeated, same, "left_anti").select(*docs.columns).unionByName(one)
    return left.select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP7_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""
