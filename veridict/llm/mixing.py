"""Operator 8: mixing sources to target weights by whole-document repetition.

A document is taken floor(rate) times, and once more with the rate's fraction as its chance. That one more is drawn
systematically: a source's documents stand in a row by size class, and by a hash within the class; the fractions are
added up along the row from an offset that the source's hash gives; who passes a whole number is taken. So each
document's chance is the fraction, and a source's taken words miss its target by about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridict.llm.common import BROADCAST_BYTES, documents, shared, unit_interval, whole_text, word_count

#: A document is repeated this often at most.
MOST = 3
#: Weights of sources in code-point order, repeated as needed; the source null comes last.
WEIGHTS = (1, 2, 3)
#: Documents of a class whose hashes are put in order together.
ROWS_PER_BUCKET = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares of all sizes by weight, at most ``most`` times a
    source's size, the excess shared again by weight. One row per source, so its windows need no partitions.

    A source is full where the level at which all it precedes (by ``most * size / weight``) are full is above its own.
    """
    ranked = sizes.withColumn("__w", F.element_at(F.lit(list(weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("double"))
    cap = (F.lit(float(most)) * F.col("source_size")).alias("__cap")
    ranked = ranked.select("*", cap).withColumn("__r", F.col("__cap") / F.col("__w"))
    all_rows = Window.partitionBy()
    order = Window.orderBy("__r", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(all_rows) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("__level", level).withColumn("__at", F.row_number().over(order))
    final = F.min(F.when(F.col("__level") <= F.col("__r"), F.struct("__at", "__level"))).over(all_rows)
    levels = levels.withColumn("__final", final)
    target = F.when(F.col("__level") > F.col("__r"), F.col("__cap")).otherwise(F.coalesce(F.col("__final.__level"), F.lit(0.0)) * F.col("__w"))
    return levels.select("source", "source_size", F.least(target, F.col("__cap")).alias("target"))


def size_class(size: Column) -> Column:
    """Sizes below 128 apart, larger ones by their first seven bits: some 64 classes for each doubling."""
    bits = F.length(F.bin(size))
    return (bits * 128 + F.call_function("shiftright", size, F.greatest(bits - 7, F.lit(0)))).cast("int")


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with what the draw goes by: source, size, class and a hash that the id and the text fix."""
    size = word_count(whole_text())
    own = docs.select(*columns, F.col("source").alias("__source"), size.alias("__size"), F.xxhash64("doc_id", "text", F.lit("mix")).alias("__h"))
    return own.withColumn("__class", size_class(F.col("__size")))


def draws(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source and class: source_size, target, the whole part of the rate, and by bucket of the hash the largest
    hash that gets one more copy (null for none).

    Rows are counted by source and class first; a bucket has ``ROWS_PER_BUCKET`` rows on average however frequent its
    class; rows of one hash (repeated documents) are one entry, and are taken or left together.
    """
    sums = [F.count(F.lit(1)).alias("n"), F.sum("__size").alias("words")]
    classes = shared(rows.groupBy("__source", "__class").agg(*sums).withColumn("buckets", F.ceil(F.col("n") / ROWS_PER_BUCKET)))
    targets = source_targets(classes.groupBy(F.col("__source").alias("source")).agg(F.sum("words").alias("source_size")), weights, most)
    targets = shared(targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    spread = by_class(rows.select("__source", "__class", "__h"), classes.select("__source", "__class", "buckets"), 40)
    bucket = F.pmod("__h", "buckets").alias("bucket")
    apart = spread.groupBy("__source", "__class", bucket, "__h").agg(F.count(F.lit(1)).alias("times"))
    buckets = apart.groupBy("__source", "__class", "bucket").agg(F.sum("times").alias("n"), F.array_sort(F.collect_list(F.struct("__h", "times"))).alias("own"))
    before = Window.partitionBy("__source", "__class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("__source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.select(F.col("__source").alias("s"), F.col("__class").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    placed = buckets.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__class") == F.col("c")))
    rated = placed.join(targets, F.col("__source").eqNullSafe(F.col("source")))
    at, fraction, offset = F.col("start") + F.col("inside"), F.col("rate") - F.floor("rate"), unit_interval(F.col("__source"), F.lit("offset"))
    wanted = (F.floor((at + F.col("n")) * fraction + offset) - F.floor(at * fraction + offset)).alias("wanted")
    # the prefix of the hashes whose rows are nearest to those wanted
    step = lambda a, x: F.struct((a["rows"] + x["times"]).alias("rows"), F.when(a["rows"] + x["times"] - F.floor(x["times"] / 2) <= F.col("wanted"), x["__h"]).otherwise(a["last"]).alias("last"))
    last = F.aggregate("own", F.struct(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("long").alias("last")), step, lambda a: a["last"])
    found = rated.select("__source", "__class", "bucket", "source_size", "target", "rate", "own", wanted).withColumn("last", last)
    of_class = found.groupBy("__source", "__class").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("rate").alias("rate"), F.map_from_entries(F.collect_list(F.struct("bucket", "last"))).alias("lasts"))
    return of_class.join(classes.select(F.col("__source").alias("s"), F.col("__class").alias("c"), "buckets"), F.col("__source").eqNullSafe(F.col("s")) & (F.col("__class") == F.col("c"))).drop("s", "c")


def by_class(rows: DataFrame, classes: DataFrame, row_bytes: int, bucket_bytes: int = 0) -> DataFrame:
    """``rows`` with what ``classes`` has on their source and class; a table counted to be small is broadcast."""
    held = classes.agg(F.count(F.lit(1)) * row_bytes + F.sum("buckets") * bucket_bytes).first()[0] or 0
    few = classes.withColumnsRenamed({"__source": "__s", "__class": "__c"})
    few = F.broadcast(few) if held <= BROADCAST_BYTES else few
    return rows.join(few, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c"))).drop("__s", "__c")


def copies_of(rows: DataFrame, drawn: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``sized`` rows with size, source_size, target and copies."""
    joined = by_class(rows, drawn, 100, 16)
    one_more = F.coalesce(F.col("__h") <= F.col("lasts")[F.pmod("__h", "buckets")], F.lit(False))
    return joined.select(*columns, F.col("__size").alias("size"), "source_size", "target", (F.floor("rate") + F.when(one_more, 1).otherwise(0)).cast("long").alias("copies"))


def mix_plan(docs: DataFrame, columns: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``columns`` (narrow ones, which are written once) of each row with size, source_size, target and copies.

    Null texts have no words; the null source is a source; a source without words gets nothing; rows that repeat an id
    and a text get equally many copies; whichever the order or number of partitions, the copies are the same.
    """
    rows = shared(sized(docs, columns))
    return copies_of(rows, shared(draws(rows, weights, most)), columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: every document as often as its plan says, with the columns of ``docs``.

    Texts are read twice, to draw and to copy, and are not dealt out.
    """
    docs = docs.select(*dict.fromkeys(docs.columns))
    drawn = shared(draws(shared(sized(docs, [])), weights, most))
    planned = copies_of(sized(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "source", "text"), ["__row"]), drawn, ["__row"])
    return planned.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(documents(spark, sf_dir), ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
