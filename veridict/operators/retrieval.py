"""Evidence selection: BM25 within each instance's pack, and the whole pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridict.functions.text import ascii_tokens
from veridict.sources.tables import shared

K1, B = 1.5, 0.75


def bm25(queries: DataFrame, units: DataFrame, top_k: int = 3, k1: float = K1, b: float = B) -> DataFrame:
    """``queries(instance_id, text)``, ``units(instance_id, ordinal, text)`` to the ``top_k`` units of each instance.

    Document frequencies and mean lengths are those of the pack. A term that the query repeats counts repeatedly; ties
    go by place in the pack; units without a term score zero and may be returned. Only terms of the query are exploded,
    so what is shuffled follows the matches, not the text.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    asked = queries.select("instance_id", ascii_tokens(F.col("text")).alias("asked"))
    sized = units.select("instance_id", "ordinal", "text").join(asked, "instance_id").withColumn("tokens", ascii_tokens(F.col("text")))
    # texts are read and cut into words once; what is kept of them is the length and the query's words
    relevant = shared(sized.select("instance_id", "ordinal", F.size("tokens").alias("length"), F.filter("tokens", lambda t: F.array_contains("asked", t)).alias("tokens")))
    packs = relevant.groupBy("instance_id").agg(F.count(F.lit(1)).alias("units"), F.avg("length").alias("mean"))
    found = relevant.select("instance_id", "ordinal", "length", F.explode("tokens").alias("term")).groupBy("instance_id", "ordinal", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = found.groupBy("instance_id", "term").agg(F.count(F.lit(1)).alias("df"))
    qtf = asked.select("instance_id", F.explode("asked").alias("term")).groupBy("instance_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    stats = df.join(qtf, ["instance_id", "term"]).join(packs, "instance_id")
    idf = F.log(1 + (F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scores = found.join(stats, ["instance_id", "term"]).groupBy("instance_id", "ordinal").agg(F.sum(part).alias("score"))
    scored = relevant.select("instance_id", "ordinal").join(scores, ["instance_id", "ordinal"], "left").select("instance_id", "ordinal", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("score"), "ordinal"))
    return scored.withColumn("place", place).where(F.col("place") <= top_k)


def full_pack(units: DataFrame) -> DataFrame:
    """Every unit, in the order of the pack."""
    return units.withColumn("place", F.row_number().over(Window.partitionBy("instance_id").orderBy("ordinal")))
