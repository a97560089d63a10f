"""Running counts over a stream of scored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verdict_counts(scored: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and (gold, verdict): how many; rows later than ``late`` are left out, and windows are then closed.

    Works on batches and on streams; a stream leaves out rows that come later than ``late``, which a batch counts. The
    per-class metrics follow from these cells.
    """
    rows = scored.withWatermark(time, late) if scored.isStreaming else scored
    return rows.groupBy(F.window(time, window).alias("w"), "gold", "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "gold", "verdict", "n")
