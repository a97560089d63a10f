"""Votes of several passes, the rules by which the ensemble abstains, and comparison of repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridict.functions.text import rounded

RULES = ("unparsable_json", "low_confidence", "empty_evidence", "checker_conflict", "ensemble_split")
DECISIVE = ("warranted", "overclaimed", "contradicted")
LOWER_IS_BETTER = ("sfwr", "augrc")
FULL_COVERAGE_ONLY = ("accuracy", "macro_f1", "evidence_f1")


def majority(ballots: DataFrame) -> DataFrame:
    """Winner of each instance (ties: first by name), its wins, and the share of all ballots, unparsed ones included.

    Two sums: per (instance, verdict), then per instance. Confidences are added up in the order of ballots, since the last
    digit of a sum of doubles depends on it and may decide a threshold; the running sum is sorted on disk where it must.
    """
    in_order = Window.partitionBy("instance_id", "verdict").orderBy("ballot_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ballots.withColumn("__sum", F.sum("confidence").over(in_order)).withColumn("__place", F.count(F.lit(1)).over(in_order))
    mean = F.max_by("__sum", "__place") / F.count("confidence")
    sums = running.groupBy("instance_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("confidence") > 0, mean).alias("mean"), F.min_by("no_eids", "ballot_no").alias("no_eids"))
    best = F.min(F.when(F.col("verdict").isNotNull(), F.struct((-F.col("n")).alias("minus"), "verdict", "mean", "no_eids"))).alias("best")
    both = sums.groupBy("instance_id").agg(best, F.sum("n").alias("ballots"))
    wins = -F.col("best.minus")
    return both.select("instance_id", F.col("best.verdict").alias("verdict"), wins.alias("wins"), "ballots", (wins / F.col("ballots")).alias("agreement"), F.col("best.mean").alias("mean_confidence"), F.col("best.no_eids").alias("no_eids"))


def abstain(votes: DataFrame, threshold: float = 0.9, unanimous: bool = False, disabled: tuple[str, ...] = (), conflict: str | None = None) -> DataFrame:
    """Fired rules in fixed order, and the emitted verdict, confidence and rationale.

    ``conflict`` names a boolean column: the numeric checker found a failure with evidence. An instance of which no
    ballot parsed only fires the first rule and cannot be rescued by disabling others.
    """
    parsed = F.col("verdict").isNotNull()
    split = (F.col("agreement") <= 0.5) | (F.col("agreement") < 1 if unanimous else F.lit(False))
    conflicts = (F.col("verdict") != "contradicted") & F.coalesce(F.col(conflict), F.lit(False)) if conflict else F.lit(False)
    tests = {"unparsable_json": ~parsed, "low_confidence": parsed & (F.col("mean_confidence") < threshold), "empty_evidence": parsed & F.col("verdict").isin(*DECISIVE) & F.coalesce("no_eids", F.lit(False)), "checker_conflict": parsed & conflicts, "ensemble_split": parsed & split}
    fired = F.filter(F.array(*[F.when(tests[r], r) for r in RULES if r not in disabled or r == "unparsable_json"]), lambda r: r.isNotNull())
    out = votes.withColumn("fired", fired).withColumn("abstain", F.size("fired") > 0)
    reason = F.format_string("abstained (%s); majority vote was %s at agreement %.2f, stated confidence %.2f.", F.array_join("fired", ", "), F.coalesce("verdict", F.lit("none")), F.coalesce("agreement", F.lit(0.0)), F.coalesce("mean_confidence", F.lit(0.0)))
    return out.select("instance_id", F.when(F.col("abstain"), "insufficient").otherwise(F.col("verdict")).alias("verdict"), rounded(F.coalesce(F.col("agreement") * F.col("mean_confidence"), F.lit(0.0)), 4).alias("confidence"), "abstain", "fired", F.when(F.col("abstain"), F.left(reason, F.lit(500))).alias("rationale_short"))


def rule_counts(emitted: DataFrame) -> DataFrame:
    """How often each rule fired; rules overlap."""
    return emitted.select(F.explode("fired").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def comparison_row(scored: DataFrame, system: str, repeat: int) -> DataFrame:
    """The figures of one scored run for a comparison; the job fails where the run could not be scored."""
    good = F.assert_true("scoreable", F.lit(f"{system}: the submission cannot be scored"))
    checked = scored.withColumn("bad", good).where("bad IS NULL")
    return checked.select(F.lit(system).alias("system"), F.lit(repeat).alias("pass"), "accuracy", "macro_f1", "evidence_f1", "sfwr", "coverage", "augrc", "answered", "total")


def repeat_medians(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """``runs(system, pass, metrics...)`` to median, smallest, largest and all values, in the order of passes, per system
    and metric."""
    long = runs.unpivot(["system", "pass"], list(metrics), "metric", "value")
    values = F.transform(F.array_sort(F.collect_list(F.struct("pass", "value"))), lambda x: x["value"])
    return long.groupBy("system", "metric").agg(F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("repeats"), values.alias("values"))


def repeat_sums(runs: DataFrame) -> DataFrame:
    """``runs(system, pass, answered, total, fallbacks)``: per system the median of answered, its total, all fallbacks."""
    return runs.groupBy("system").agg(F.round(F.median("answered")).cast("long").alias("answered"), F.min_by("total", "pass").alias("total"), F.sum("fallbacks").alias("fallbacks"))


def dominance(medians: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Per metric the leader by median, and whether its worst run is better than (strict), level with (weak), or worse
    than (none) any rival's best. Metrics over answered rows only compare systems of full coverage (``coverage(system,
    coverage)``); with fewer than two systems there is no leader."""
    rows = medians
    if coverage is not None:
        rows = rows.join(coverage, "system").where(~F.col("metric").isin(*FULL_COVERAGE_ONLY) | (F.col("coverage") >= 1 - 1e-9))
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    best, worst = F.greatest(sign * F.col("least"), sign * F.col("most")), F.least(sign * F.col("least"), sign * F.col("most"))
    signed = rows.select("metric", "system", (sign * F.col("median")).alias("m"), best.alias("best"), worst.alias("worst"))
    leaders = signed.groupBy("metric").agg(F.min(F.struct((-F.col("m")).alias("m"), "system", "worst")).alias("top"), F.count(F.lit(1)).alias("systems"))
    rivals = signed.join(leaders, "metric").where("system <> top.system").groupBy("metric").agg(F.max("best").alias("rival"))
    judged = leaders.join(rivals, "metric", "left")
    verdict = F.when(F.col("systems") < 2, "none").when(F.col("top.worst") > F.col("rival"), "strict").when(F.col("top.worst") >= F.col("rival"), "weak").otherwise("none")
    return judged.select("metric", F.when(F.col("systems") >= 2, F.col("top.system")).alias("leader"), verdict.alias("dominance"))
