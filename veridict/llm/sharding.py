"""Operator 3: rendezvous hashing of record keys over weighted shards, with gapless slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.llm.common import documents, unit_interval, whole_text

#: Rows that one task numbers at a time.
ROWS_PER_BUCKET = 20_000
#: Shards of the registered query.
SHARDS = 24


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """Exponential race: the shard with the smallest score owns the key, with chance in proportion to its weight."""
    return F.struct((-F.log(unit_interval(key, F.lit(shard))) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """``struct(score, shard)`` of the owner. Only the key, the shard's number and its weight decide, so a shard that is
    added takes keys only into itself, and one that is removed gives up only its own. Null keys count as one key."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    scores = [shard_score(key, i, w) for i, w in enumerate(weights)]
    return reduce(lambda a, b: F.when(b < a, b).otherwise(a), scores) if len(scores) < 3 else F.least(*scores)


def number_within(rows: DataFrame, group: str, order: list[str], slot: str, expected_rows: int) -> DataFrame:
    """Adds gapless numbers from 0 within each value of ``group``, without bringing a group into one task.

    Equal rows are first summed up, so that a row repeated very often is one row here; the rest is dealt to hashed
    buckets, whose counts alone are summed up in order, and rows are numbered within their bucket.
    """
    buckets = max(1, -(-expected_rows // ROWS_PER_BUCKET))
    names = rows.columns
    summed = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    place = [group, "__bucket"]
    starts = summed.groupBy(*place).agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*place, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*place).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    numbered = summed.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, place)
    first = (F.col("__start") + F.col("__before")).alias("__first")
    return numbered_rows(numbered.select(*names, first, "__n"), names, slot)


def numbered_rows(summed: DataFrame, names: list[str], slot: str) -> DataFrame:
    """Rows of ``summed(names, __first, __n)`` as often as ``__n`` says, numbered on from ``__first``. What stands very
    often is cut into ranges that are dealt out before they are written out."""
    ends = F.col("__first") + F.col("__n")
    few = summed.where(F.col("__n") <= ROWS_PER_BUCKET).select(*names, F.explode(F.sequence(F.col("__first"), ends - 1)).alias(slot))
    cut = summed.where(F.col("__n") > ROWS_PER_BUCKET).select(*names, ends.alias("__end"), F.explode(F.sequence(F.col("__first"), ends - 1, F.lit(ROWS_PER_BUCKET).cast("long"))).alias("__from"))
    dealt = cut.repartition("__from", *names)
    many = dealt.select(*names, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + ROWS_PER_BUCKET, F.col("__end")) - 1)).alias(slot))
    return few.unionByName(many)


def shard_rows(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Null texts count as empty; null ids share a shard; repeated rows get a slot each; other columns are ignored.
    """
    weights = weights or [1.0] * shards
    text = whole_text()
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    owned = rows.withColumn("__best", rendezvous(F.col("doc_id"), weights))
    extra = shard_score(F.col("doc_id"), len(weights), 1.0)
    placed = owned.select("doc_id", "size", "text_crc32", F.col("__best.shard").alias("shard"), F.when(extra < F.col("__best"), F.lit(len(weights))).otherwise(F.col("__best.shard")).alias("grown_shard"))
    numbered = number_within(placed, "shard", ["doc_id", "size", "text_crc32"], "slot", -(-docs.count() // len(weights)))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir))
