"""Operator 5: importance resampling. Hashed n-gram models of labelled good texts and of all texts; documents are weighed
by the ratio of the two and sampled without replacement by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridict.llm.common import documents, shared, table, unit_interval, whole_text

#: Buckets of the hashed words and of the hashed pairs of neighbours; a model is so many numbers at any corpus size.
WORDS, PAIRS = 1 << 18, 1 << 19
#: Smoothing: counts added to every bucket of both models, more for the sparser pairs.
WORD_PRIOR, PAIR_PRIOR = 2.0, 50.0
#: The good model is fitted on at most so many labelled good documents, those with the smallest hashes of their ids.
MOST_LABELLED = 100_000


def _folded(hashes: np.ndarray, size: int) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(31)) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def buckets(text: bytes) -> np.ndarray:
    """Bucket of each word, and beyond ``WORDS`` of each pair of neighbours, case of A-Z aside."""
    words = text.lower().split()
    one = np.fromiter(map(crc32, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.concatenate([_folded(one * np.uint64(0x9E3779B97F4A7C15), WORDS), WORDS + _folded(two, PAIRS)])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    good, every = np.zeros(WORDS + PAIRS, np.int64), np.zeros(WORDS + PAIRS, np.int64)
    for batch in batches:
        for text, label in zip(batch["text"], batch["good"]):
            found = buckets(text)
            np.add.at(every, found, 1)
            if label:
                np.add.at(good, found, 1)
    used = np.flatnonzero(every)
    yield pd.DataFrame({"bucket": used, "good": good[used], "every": every[used]})


def models(flagged: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed counts by bucket of the good texts, and of all texts brought to the same total, of ``flagged(text, good)``.

    With the same prior on both sides either is a distribution over the words' and over the pairs' buckets times one
    constant, so their ratio is that of the two models. Words and pairs of all documents are counted.
    """
    sums = flagged.select("text", "good").mapInPandas(_counts, "bucket int, good long, every long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every"))
    model = sums.toArrow()  # one row a bucket at most
    good, every = np.zeros(WORDS + PAIRS), np.zeros(WORDS + PAIRS)
    at = model["bucket"].to_numpy()
    good[at], every[at] = model["good"].to_numpy(), model["every"].to_numpy()
    for part, prior in ((slice(0, WORDS), WORD_PRIOR), (slice(WORDS, None), PAIR_PRIOR)):
        every[part] *= good[part].sum() / max(every[part].sum(), 1.0)
        every[part] += prior
        good[part] += prior
    return good, every


def log_weight(text: bytes, good: np.ndarray, every: np.ndarray, own: bool) -> float:
    """Sum of log p_good - log p_all. A text that the good model was fitted on (``own``) is weighed by the model of the
    others, so that it gets no credit for itself."""
    found = buckets(text)
    if not own:
        return float((np.log(good[found]) - np.log(every[found])).sum())
    once, times = np.unique(found, return_counts=True)
    return float((times * (np.log(good[once] - times) - np.log(every[once]))).sum())


def kth_largest(keys: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, exactly: sixteen bits a round, 65,536 counts a round at most."""
    known, rest = 0, keys.select(F.col(column).bitwiseXOR(F.lit(-(1 << 63))).alias("u"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(rest.groupBy(digit.alias("d")).count().collect(), reverse=True)
        for d, n in counts:
            if n >= k:
                break
            k -= n
        known = known << 16 | d
        rest = rest.where(digit == d)
    return known - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, gumbel_key, kept of the sampled documents: the ``share`` with the largest keys.

    ``labels(doc_id, quality, toxic)``: good is quality 1 and not toxic; a document with several labels is good if all
    are. By default the share is that of the good among the labelled. Null and empty texts weigh zero; very long texts
    count in full, and the weight is not divided by length; rows that tie at the threshold all stay; rows with one id and
    text have one key, and so stay or go together; other columns are ignored; without documents or good labels nothing
    is sampled.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    judged = shared(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good")))
    if share is None:
        share = judged.agg(F.avg("good")).first()[0] or 0.0
    good_ids = shared(judged.where("good = 1").select("doc_id", F.lit(True).alias("good")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))
    flagged = docs.select("doc_id", F.encode(whole_text(), "UTF-8").alias("text"), unit_interval(F.col("doc_id"), F.col("text"), F.lit("gumbel")).alias("u"))
    flagged = flagged.join(F.broadcast(good_ids), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    model = docs.sparkSession.sparkContext.broadcast(models(flagged))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weight = np.fromiter((log_weight(t, *model.value, own) for t, own in zip(batch.pop("text"), batch.pop("good"))), np.float64, len(batch))
            key = weight - np.log(-np.log(batch.pop("u").to_numpy(np.float64)))
            bits = key.view(np.int64)
            yield batch.assign(log_weight=weight, gumbel_key=key, rank=np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))

    keys = shared(flagged.mapInPandas(keyed, "doc_id long, log_weight double, gumbel_key double, rank long"))
    k = round(keys.count() * share)
    kept = keys.where(F.col("rank") >= kth_largest(keys, "rank", k)) if k else keys.limit(0)
    return kept.select("doc_id", "log_weight", "gumbel_key", F.lit(True).alias("kept"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
