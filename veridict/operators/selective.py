"""Selective risk: ranking by confidence, and the risk-coverage curve with expected values within ties.

Rows are summed up by confidence first. Running sums go over bins of the confidence (a fixed number of rows), then over
the groups within each bin, so that no task has all rows, nor all of one confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridict.operators.evaluation import ratio
from veridict.sources.tables import shared, stepped

BINS = 4096
LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
TARGETS = (0.0, 0.05, 0.1, 0.2)


def units(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per gold id: answered, confidence, error, severe, risky. Abstained and missing ones are errors, never severe."""
    p = pred.select("instance_id", F.col("verdict").alias("said"), "confidence", F.coalesce("abstain", F.lit(False)).alias("a"))
    joined = gold.select("instance_id", "verdict").join(p, "instance_id", "left")
    there = F.coalesce(~F.col("a"), F.lit(False))
    one = lambda c: F.when(c, 1).otherwise(0)
    risky = F.col("verdict") != "warranted"
    return joined.select("instance_id", there.alias("answered"), F.when(there, F.col("confidence")).otherwise(F.lit(float("-inf"))).alias("confidence"), one(~there | (F.col("verdict") != F.col("said"))).alias("error"), one(there & risky & (F.col("said") == "warranted")).alias("severe"), one(risky).alias("risky"))


def _bin() -> Column:
    return F.when(F.col("answered"), F.floor(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * BINS)).otherwise(-1).cast("int")


def groups(rows: DataFrame) -> DataFrame:
    """Ties: per confidence the size, the sums, and the sums of all groups before it; abstentions are one group."""
    sums = ["size", "error", "severe", "risky"]
    tied = rows.groupBy("answered", "confidence").agg(F.count(F.lit(1)).alias("size"), *[F.sum(c).alias(c) for c in sums[1:]]).withColumn("bin", _bin())
    before = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # at most BINS + 2 rows
    bins = tied.groupBy("bin").agg(*[F.sum(c).alias(c) for c in sums]).select("bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in sums])
    inside = Window.partitionBy("bin").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, -1)
    both = tied.join(bins, "bin")
    return both.select("answered", "confidence", *sums, *[(F.col(f"b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long").alias(f"before_{c}") for c in sums])


def rank(rows: DataFrame) -> DataFrame:
    """Places by confidence downwards, then id; abstained and missing ones last.

    One sort by ranges of (confidence, id): a row's place is its number in its range plus the rows of the ranges before,
    of which one count each is gathered.
    """
    ordered = rows.orderBy(F.desc("answered"), F.desc("confidence"), "instance_id").withColumn("__at", F.monotonically_increasing_id())
    placed = shared(ordered.select("instance_id", "answered", "error", "severe", F.shiftright("__at", 33).alias("__range"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__in")))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("__in") + 1
    return placed.join(starts, "__range").select("instance_id", "answered", "error", "severe", place.cast("long").alias("place"))


def curve(rows: DataFrame) -> DataFrame:
    """A point for each k: coverage, risk, generalised risk, SFWR, whether the k-th is still answered."""
    steps = stepped(groups(rows), "size", "step")
    share = F.col("step") / F.col("size")
    at = lambda c: F.col(f"before_{c}") + share * F.col(c)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    k = (F.col("before_size") + F.col("step")).cast("long")
    points = steps.join(F.broadcast(total)).select(k.alias("k"), (k / F.col("total")).alias("coverage"), (at("error") / k).alias("risk"), (at("error") / F.col("total")).alias("generalized"), ratio(at("severe"), at("risky")).alias("sfwr"), F.col("answered").alias("voluntary"))
    return points


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: added up when short, else by Euler and Maclaurin to some fifteen digits."""
    x = n.cast("double")
    long = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    short = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(64)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    return F.when(n == 0, 0.0).when(n <= 64, short).otherwise(long)


def areas(rows: DataFrame) -> DataFrame:
    """What ``summary`` has, from the groups of equal confidence, without a row for each point.

    Within a group the k-th risk is (a + b k) / k, whose sum over the group is b times its size plus a times a difference
    of harmonic numbers; the generalised risk is linear in k.
    """
    known = groups(rows).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))  # one row
    size, error, n0, e0 = (F.col(c) for c in ("size", "error", "before_size", "before_error"))
    b = error / size
    risk = size * b + (e0 - n0 * b) * (harmonic(n0 + size) - harmonic(n0))
    generalized = (size * e0 + error * (size + 1) / 2) / F.col("total")
    mean = lambda x, n: F.round(F.coalesce(F.sum(x) / F.sum(n), F.lit(0.0)), 9)
    answered = lambda x: F.when(F.col("answered"), x)
    return known.select("size", "answered", risk.alias("risk"), generalized.alias("generalized")).agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("points"), mean("risk", "size").alias("aurc"), mean("generalized", "size").alias("augrc"), mean(answered(F.col("risk")), answered(F.col("size"))).alias("aurc_voluntary")
    )


def summary(points: DataFrame) -> DataFrame:
    """Areas under the risk and the generalised risk, over all points and over those answered; zero if there are none."""
    mean = lambda c, when=None: F.round(F.coalesce(F.avg(F.when(when, F.col(c)) if when is not None else F.col(c)), F.lit(0.0)), 9)
    return points.agg(F.count(F.lit(1)).alias("points"), mean("risk").alias("aurc"), mean("generalized").alias("augrc"), mean("risk", F.col("voluntary")).alias("aurc_voluntary"))


def risk_at(points: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Risk and SFWR at fixed coverages: of n points the one with k = ceil(level * n), within 1 .. n."""
    spark = points.sparkSession
    wanted = spark.createDataFrame([(x,) for x in levels], "level double")
    n = points.agg(F.count(F.lit(1)).alias("n"))
    places = wanted.join(F.broadcast(n)).where("n > 0").select("level", F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.col("level") * F.col("n")))).alias("k"))
    return points.join(F.broadcast(places), "k").select("level", "k", F.round("risk", 9).alias("risk"), F.round("sfwr", 9).alias("sfwr"))


def coverage_at(points: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """The largest coverage of any answered point whose SFWR is within the target."""
    best = [F.coalesce(F.max(F.when(F.col("voluntary") & (F.col("sfwr") <= t), F.col("coverage"))), F.lit(0.0)).alias(f"t{i}") for i, t in enumerate(targets)]
    lines = F.array(*[F.struct(F.lit(t).alias("target"), F.round(f"t{i}", 9).alias("coverage")) for i, t in enumerate(targets)])
    return points.agg(*best).select(F.inline(lines))
