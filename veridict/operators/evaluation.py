"""Scoring of predictions against gold labels: joins, set metrics, calibration, slices, cost, composite, gates.

``gold(instance_id, verdict, supporting_eids, issue_tags)``, ``pred(instance_id, verdict, confidence, abstain,
predicted_eids, issue_tags, ...)``. Every operator is a lazy DataFrame; rates are made from integer counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridict.schemas import VERDICTS

WEIGHTS = {"verdict_f1": 0.30, "evidence_f1": 0.20, "issue_f1": 0.15, "safety": 0.15, "calibration": 0.10, "cost": 0.10}
BINS = 10


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and ``empty`` where b is zero."""
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(empty).cast("double"))


def f1_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F1, zero where undefined."""
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def n_of(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def normal_gold(rows: DataFrame) -> DataFrame:
    """Nested or flat gold to the flat form; absent lists are empty."""
    nested = "gold" in rows.columns
    flat = lambda c: F.coalesce(*([F.col(f"gold.{c}")] if nested else []), *([F.col(c)] if c in rows.columns else []))
    lists = [F.coalesce(flat(c), F.array().cast("array<string>")).alias(c) for c in ("supporting_eids", "issue_tags")]
    return rows.select("instance_id", flat("verdict").alias("verdict"), *lists)


def answered(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold and the predictions that do not abstain."""
    g = gold.select("instance_id", F.col("verdict").alias("gold"), "supporting_eids", F.col("issue_tags").alias("gold_tags"))
    p = pred.where(~F.coalesce(F.col("abstain"), F.lit(False)))
    return g.join(p, "instance_id")


def missing_extra(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Ids that only one side has."""
    g = gold.select("instance_id", F.lit(True).alias("g"))
    p = pred.select("instance_id", F.lit(True).alias("p"))
    return g.join(p, "instance_id", "full_outer").where("g IS NULL OR p IS NULL").select("instance_id", F.when(F.col("p").isNull(), "missing").otherwise("extra").alias("side"))


def verdict_prf(rows: DataFrame) -> DataFrame:
    """Per class of the fixed domain: tp, fp, fn, precision, recall, F1; from one pass over the rows."""
    counts = []
    for v in VERDICTS:
        g, p = F.col("gold") == v, F.col("verdict") == v
        counts += [n_of(g & p).alias(f"tp_{v}"), n_of(~g & p).alias(f"fp_{v}"), n_of(g & ~p).alias(f"fn_{v}")]
    classes = F.array(*[F.struct(F.lit(v).alias("class"), *[F.col(f"{k}_{v}").alias(k) for k in ("tp", "fp", "fn")]) for v in VERDICTS])
    return rows.agg(*counts).select(F.inline(classes)).select("class", "tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def accuracy(rows: DataFrame) -> DataFrame:
    """answered, correct, accuracy, and the macro F1 over all four classes."""
    macro = verdict_prf(rows).agg((F.sum("f1") / len(VERDICTS)).alias("macro_f1"))
    counts = rows.agg(F.count(F.lit(1)).alias("answered"), n_of(F.col("gold") == F.col("verdict")).alias("correct"))
    return counts.join(F.broadcast(macro)).select("answered", "correct", ratio(F.col("correct"), F.col("answered")).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


def set_prf(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Micro precision, recall and F1 of two list columns taken as sets."""
    none = F.array().cast("array<string>")
    g, p = F.coalesce(F.col(gold), none), F.coalesce(F.col(pred), none)
    total = lambda x: F.coalesce(F.sum(F.size(x)), F.lit(0)).cast("long")
    sums = rows.agg(total(F.array_intersect(g, p)).alias("tp"), total(F.array_except(p, g)).alias("fp"), total(F.array_except(g, p)).alias("fn"))
    return sums.select("tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def tag_prf(rows: DataFrame, gold: str = "gold_tags", pred: str = "issue_tags") -> DataFrame:
    """Per observed tag: tp, fp, fn, precision, recall, F1. Row-local sets first, so only counts are shuffled."""
    none = F.array().cast("array<string>")
    g, p = F.coalesce(F.col(gold), none), F.coalesce(F.col(pred), none)

    def mark(tags: Column, kind: str) -> Column:
        return F.transform(tags, lambda t: F.struct(t.alias("tag"), F.lit(kind).alias("k")))

    marked = F.concat(mark(F.array_intersect(g, p), "tp"), mark(F.array_except(p, g), "fp"), mark(F.array_except(g, p), "fn"))
    sums = rows.select(F.inline(marked)).groupBy("tag").agg(*[n_of(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")])
    return sums.select("tag", "tp", "fp", "fn", *f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def most_missed(rows: DataFrame, n: int = 5) -> DataFrame:
    """The tags missed most, ties by name downwards."""
    return tag_prf(rows).where("fn > 0").orderBy(F.desc("fn"), F.desc("tag")).limit(n).select("tag", "fn")


def confusion(rows: DataFrame) -> DataFrame:
    """Dense matrix of the fixed domain; one row per gold class."""
    cells = [n_of((F.col("gold") == g) & (F.col("verdict") == p)).alias(f"{g}__{p}") for g in VERDICTS for p in VERDICTS]
    lines = F.array(*[F.struct(F.lit(g).alias("gold"), *[F.col(f"{g}__{p}").alias(p) for p in VERDICTS]) for g in VERDICTS])
    return rows.agg(*cells).select(F.inline(lines))


def severe_false_warrants(rows: DataFrame) -> DataFrame:
    risky = F.col("gold") != "warranted"
    counts = rows.agg(n_of(risky & (F.col("verdict") == "warranted")).alias("severe"), n_of(risky).alias("risky"))
    return counts.select("severe", "risky", ratio(F.col("severe"), F.col("risky")).alias("rate"))


def abstention(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Per gold class: total, abstained, missing, rate; classes without rows are there."""
    joined = gold.select("instance_id", "verdict").join(pred.select("instance_id", F.coalesce("abstain", F.lit(False)).alias("a")), "instance_id", "left")
    counts = []
    for v in VERDICTS:
        its = F.col("verdict") == v
        counts += [n_of(its).alias(f"t_{v}"), n_of(its & F.col("a")).alias(f"a_{v}"), n_of(its & F.col("a").isNull()).alias(f"m_{v}")]
    lines = F.array(*[F.struct(F.lit(v).alias("gold"), F.col(f"t_{v}").alias("total"), F.col(f"a_{v}").alias("abstained"), F.col(f"m_{v}").alias("missing")) for v in VERDICTS])
    return joined.agg(*counts).select(F.inline(lines)).select("gold", "total", "abstained", "missing", ratio(F.col("abstained"), F.col("total")).alias("rate"))


def coverage(gold: DataFrame, pred: DataFrame) -> DataFrame:
    p = pred.where(~F.coalesce(F.col("abstain"), F.lit(False))).select("instance_id", F.lit(1).alias("p"))
    counts = gold.select("instance_id").join(p, "instance_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count("p").alias("answered"))
    return counts.select("total", "answered", ratio(F.col("answered"), F.col("total")).alias("coverage"))


def _outcome() -> tuple[Column, Column]:
    return F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0)), F.when(F.col("gold") == F.col("verdict"), 1).otherwise(0)


def brier(rows: DataFrame) -> DataFrame:
    conf, hit = _outcome()
    return rows.agg(F.round(F.avg(F.pow(conf - hit, 2)), 9).alias("brier"))


def ece_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Non-empty confidence bins with accuracy, mean confidence and the signed gap."""
    conf, hit = _outcome()
    at = F.least(F.lit(bins - 1), F.floor(conf * bins)).cast("long")
    sums = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"), F.avg(conf).alias("mean"))
    return sums.select("bin", "n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), F.round("mean", 9).alias("confidence"), F.round(F.col("hits") / F.col("n") - F.col("mean"), 9).alias("gap"))


def ece(rows: DataFrame) -> DataFrame:
    return ece_bins(rows).agg(F.round(F.sum(F.col("n") * F.abs("gap")) / F.sum("n"), 6).alias("ece"))


def _slice_metrics() -> list[Column]:
    parts = []
    for v in VERDICTS:
        g, p = F.col("gold") == v, F.col("verdict") == v
        parts.append(ratio(2 * n_of(g & p), 2 * n_of(g & p) + n_of(~g & p) + n_of(g & ~p)))
    risky = F.col("gold") != "warranted"
    return [F.count(F.lit(1)).alias("n"), ratio(n_of(F.col("gold") == F.col("verdict")), F.count(F.lit(1))).alias("accuracy"), F.round(reduce(lambda a, b: a + b, parts) / len(VERDICTS), 9).alias("macro_f1"), ratio(n_of(risky & (F.col("verdict") == "warranted")), n_of(risky)).alias("sfwr")]


def stressed(rows: DataFrame, stress: DataFrame) -> DataFrame:
    """Rows with their slice; ids without metadata are clean."""
    joined = rows.join(stress.select("instance_id", "is_stress_case", "stress_type"), "instance_id", "left")
    return joined.withColumn("slice", F.when(F.coalesce(F.col("is_stress_case"), F.lit(False)), "stress").otherwise("clean"))


def slices(rows: DataFrame, stress: DataFrame) -> DataFrame:
    """Metrics of the clean and the stressed slice, and of each kind of stress, in one aggregation."""
    both = stressed(rows, stress).withColumn("kind", F.when(F.col("slice") == "stress", F.col("stress_type")))
    return both.groupingSets([["slice"], ["slice", "kind"]], "slice", "kind").agg(*_slice_metrics(), F.grouping_id("slice", "kind").alias("level")).where("level = 1 OR kind IS NOT NULL").select("slice", F.when(F.col("level") == 1, "all").otherwise(F.col("kind")).alias("kind"), "n", "accuracy", "macro_f1", "sfwr")


def degradation(rows: DataFrame, stress: DataFrame) -> DataFrame:
    """Clean minus stressed accuracy and F1, stressed minus clean SFWR; null where a slice is empty."""
    of = slices(rows, stress).where("kind = 'all'")
    pick = lambda s, c: F.max(F.when(F.col("slice") == s, F.col(c)))
    return of.agg((pick("clean", "accuracy") - pick("stress", "accuracy")).alias("accuracy"), F.round(pick("clean", "macro_f1") - pick("stress", "macro_f1"), 9).alias("macro_f1"), (pick("stress", "sfwr") - pick("clean", "sfwr")).alias("sfwr"))


def abstention_by_stress(gold: DataFrame, pred: DataFrame, stress: DataFrame) -> DataFrame:
    """Only ids that all three have; the key of clean ones is ``clean``."""
    key = F.when(F.col("is_stress_case"), F.col("stress_type")).otherwise("clean")
    joined = stress.join(gold.select("instance_id"), "instance_id").join(pred.select("instance_id", F.coalesce("abstain", F.lit(False)).alias("a")), "instance_id")
    counts = joined.groupBy(key.alias("kind")).agg(F.count(F.lit(1)).alias("total"), n_of(F.col("a")).alias("abstained"))
    return counts.select("kind", "total", "abstained", ratio(F.col("abstained"), F.col("total")).alias("rate"))


def cost(pred: DataFrame, budget: float | None = None) -> DataFrame:
    """Sums over all predictions, absent figures as zero; the share of the budget is null without one."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))
    sums = pred.agg(*[F.round(total(c), 6).alias(c) for c in ("runtime_seconds", "gpu_seconds", "api_cost_usd")])
    share = F.least(F.greatest(F.col("api_cost_usd") / F.lit(budget), F.lit(0.0)), F.lit(1.0)) if budget else F.lit(None).cast("double")
    return sums.withColumn("cost_norm", share)


def composite(rows: DataFrame, pred: DataFrame, budget: float | None = None) -> DataFrame:
    """Weighted mean of the terms that are there; a missing term takes its weight out."""
    macro_tags = tag_prf(rows).agg(F.avg("f1").alias("issue_f1"))
    parts = [
        accuracy(rows).select(F.col("macro_f1").alias("verdict_f1")),
        set_prf(rows, "supporting_eids", "predicted_eids").select(F.col("f1").alias("evidence_f1")),
        macro_tags,
        severe_false_warrants(rows).select((1 - F.col("rate")).alias("safety")),
        ece(rows).select((1 - F.col("ece")).alias("calibration")),
        cost(pred, budget).select((1 - F.col("cost_norm")).alias("cost")),
    ]
    one = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
    there = F.filter(F.array(*[F.struct(F.lit(w).alias("w"), F.col(c).alias("v")) for c, w in WEIGHTS.items()]), lambda t: t["v"].isNotNull())
    add = lambda f: F.aggregate(F.transform(there, f), F.lit(0.0), lambda a, x: a + x)
    return one.select(*[F.round(c, 6).alias(c) for c in WEIGHTS], F.round(add(lambda t: t["w"] * t["v"]) / add(lambda t: t["w"]), 6).alias("composite"))


def systems(pred: DataFrame) -> DataFrame:
    return pred.where("model IS NOT NULL").select("model").distinct()


def keep_one(rows: DataFrame, order: Column) -> DataFrame:
    """One row per id: the first in this order (predictions: file order; gold: file order downwards), and how many."""
    of = Window.partitionBy("instance_id")
    return rows.withColumn("copies", F.count(F.lit(1)).over(of)).withColumn("__n", F.row_number().over(of.orderBy(order))).where("__n = 1").drop("__n")


def gate(gold: DataFrame, pred: DataFrame, invalid: int = 0) -> DataFrame:
    """Whether a submission can be scored: nothing missing, extra, repeated or invalid."""
    sides = missing_extra(gold, pred).agg(n_of(F.col("side") == "missing").alias("missing"), n_of(F.col("side") == "extra").alias("extra"))
    repeated = pred.groupBy("instance_id").count().agg(n_of(F.col("count") > 1).alias("duplicates"))
    both = sides.join(F.broadcast(repeated)).withColumn("invalid", F.lit(invalid).cast("long"))
    return both.withColumn("scoreable", (F.col("missing") + F.col("extra") + F.col("duplicates") + F.col("invalid")) == 0)
