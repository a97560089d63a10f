"""The auditing run: claims and packs in, valid predictions out.

Four parts can be exchanged: the selector (which units go into the prompt), the model (prompts to replies), the tool
(lines for the prompt before, corrections after) and the strategy (one pass, or votes with rules to abstain).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridict.operators import ensemble, numeric, prediction, retrieval
from veridict.sources import models
from veridict.sources.tables import shared

#: ``(instances) -> (instance_id, units)`` with the chosen units in order.
Selector = Callable[[DataFrame], DataFrame]
#: ``(instance_id, prompt) -> (instance_id, reply, runtime_seconds)``.
Model = Callable[[DataFrame], DataFrame]


def whole_pack(instances: DataFrame) -> DataFrame:
    return instances.select("instance_id", F.coalesce("pack", F.array()).alias("units"))


def by_bm25(top_k: int = 3) -> Selector:
    """The units of a pack that fit the claim best, in the order of their scores."""

    def select(instances: DataFrame) -> DataFrame:
        units = instances.select("instance_id", F.posexplode("pack").alias("ordinal", "unit")).withColumn("text", F.col("unit.text"))
        best = retrieval.bm25(instances.select("instance_id", F.col("claim").alias("text")), units.select("instance_id", "ordinal", "text"), top_k)
        chosen = best.join(units.select("instance_id", "ordinal", "unit"), ["instance_id", "ordinal"]).groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("place", "unit"))).alias("u"))
        picked = chosen.select("instance_id", F.transform("u", lambda x: x["unit"]).alias("units"))
        return whole_pack(instances).select("instance_id", F.slice("units", 1, 0).alias("none")).join(picked, "instance_id", "left").select("instance_id", F.coalesce("units", "none").alias("units"))

    return select


def calls(function: Callable[[str], str]) -> Model:
    """A model that is a function of a prompt, called where the prompts are."""
    return lambda prompts: models.ask(prompts, function)


@dataclass(frozen=True)
class Tool:
    """``check`` adds columns to (claim, pack = the chosen units); ``brief`` says of them what the prompt gets too (or
    null); ``refine`` corrects predictions. Neither touches what the model did not answer."""

    check: Callable[[DataFrame], DataFrame]
    brief: Callable[[], Column]
    refine: Callable[[DataFrame], DataFrame]


def numeric_tool() -> Tool:
    """The numeric checker: its findings go into the prompt, and a failed check makes the verdict contradicted."""
    return Tool(numeric.check, lambda: F.when(F.size("checks") > 0, numeric.brief(F.col("checks"))), lambda rows: numeric.override(rows, protect="fallback"))


def audit(instances: DataFrame, select: Selector, model: Model, name: str, tool: Tool | None = None, retries: int = 1) -> DataFrame:
    """``instances(instance_id, claim, pack, allowed)`` to one prediction each, with ``fallback`` true where no reply
    could be read in ``retries`` + 1 tries.

    Only instances still without a readable reply are asked again; each round's replies are written once, since a model
    need not repeat itself. Without allowed ids those of the pack are allowed. Repeated ids are not: the job fails.
    """
    if retries < 0:
        raise ValueError("retries must not be negative")
    ids = F.filter(F.transform("pack", lambda u: u["eid"]), lambda e: e != "")
    allowed = F.when(F.size("allowed") > 0, F.col("allowed")).otherwise(F.coalesce(ids, F.array().cast("array<string>")))
    chosen = instances.select("instance_id", "claim", allowed.alias("allowed")).join(select(instances).withColumnRenamed("units", "pack"), "instance_id")
    text = prediction.prompt(F.col("claim"), F.col("pack"))
    if tool:
        chosen = tool.check(chosen)
        text = F.concat(text, F.coalesce(F.concat(F.lit("\n"), tool.brief()), F.lit("")))
    one = F.assert_true(F.count(F.lit(1)).over(Window.partitionBy("instance_id")) == 1, F.lit("repeated instance_id"))
    chosen = shared(chosen.withColumn("prompt", text).withColumn("__one", one).where("__one IS NULL").drop("__one"))
    left, rounds = chosen.select("instance_id", "prompt"), []
    for _ in range(retries + 1):
        replies = shared(model(left).withColumn("parsed", prediction.recover_json(F.col("reply"))))
        rounds.append(replies.select("instance_id", "parsed", "runtime_seconds"))
        left = left.join(replies.where("parsed IS NOT NULL"), "instance_id", "left_anti")
        if left.isEmpty():
            break
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    answers = every.groupBy("instance_id").agg(F.any_value("parsed", True).alias("parsed"), F.sum("runtime_seconds").alias("runtime_seconds"))
    asked = chosen.drop("prompt").join(answers, "instance_id", "left").withColumn("fallback", F.col("parsed").isNull())
    filled = prediction.with_fallback(prediction.normalise(asked.withColumns({"__parsed": F.col("parsed"), "__allowed": F.col("allowed")}), "__parsed", "__allowed"))
    refined = tool.refine(filled) if tool else filled
    return envelope(refined, name, tool is not None)


def envelope(rows: DataFrame, name: str, checked: bool) -> DataFrame:
    """The columns of a prediction record; what a run does not measure costs nothing."""
    zero = F.lit(0.0)
    system = F.struct(F.lit(name).alias("model"), F.lit(checked).alias("uses_numeric_checker"), F.lit(False).alias("uses_lora"), F.lit(False).alias("uses_vlm"))
    return rows.select(
        "instance_id", "verdict", "confidence", "predicted_eids", "issue_tags", "abstain", "rationale_short", F.coalesce("runtime_seconds", zero).alias("runtime_seconds"),
        F.struct(zero.alias("gpu_seconds"), zero.alias("api_cost_usd")).alias("estimated_cost"), system.alias("system_info"), "fallback",
    )


def audit_by_votes(instances: DataFrame, select: Selector, model: Model, name: str, votes: int = 3, threshold: float = 0.9, unanimous: bool = False, disabled: tuple[str, ...] = (), tool: Tool | None = None, retries: int = 1) -> DataFrame:
    """Several passes, their majority, and the rules by which it abstains; also ``fired``.

    Evidence, tags and rationale are those of the winner's first ballot. An instance of which no ballot was read keeps
    the last pass's fallback as it is.
    """
    if votes < 1:
        raise ValueError("at least one vote is needed")
    ballots = None
    for n in range(votes):
        own = shared(audit(instances, select, model, name, tool, retries)).withColumn("ballot_no", F.lit(n))
        ballots = own if ballots is None else ballots.unionByName(own)
    read = ~F.col("fallback")
    cast = ballots.select("instance_id", "ballot_no", F.when(read, F.col("verdict")).alias("verdict"), F.when(read, F.col("confidence")).alias("confidence"), (F.size("predicted_eids") == 0).alias("no_eids"))
    units = select(instances).withColumnRenamed("units", "pack").join(instances.select("instance_id", "claim"), "instance_id")
    failed = numeric.check(units).select("instance_id", F.exists("checks", lambda c: (c["status"] == "failed") & (F.size(c["eids"]) > 0)).alias("conflict"))
    voted = ensemble.majority(cast).join(failed, "instance_id", "left")
    emitted = ensemble.abstain(voted, threshold, unanimous, disabled, conflict="conflict").select("instance_id", F.col("verdict").alias("e_verdict"), F.col("confidence").alias("e_confidence"), F.col("abstain").alias("e_abstain"), "fired", F.col("rationale_short").alias("e_rationale"))
    winners = voted.select("instance_id", F.col("verdict").alias("won"))
    order = [F.desc(F.col("verdict").eqNullSafe(F.col("won")) & read), F.when(F.col("won").isNull(), -F.col("ballot_no")).otherwise(F.col("ballot_no"))]
    first = ballots.join(winners, "instance_id").withColumn("__n", F.row_number().over(Window.partitionBy("instance_id").orderBy(*order))).where("__n = 1").drop("__n", "ballot_no")
    both = first.join(emitted, "instance_id")
    take = lambda new, old: F.when(F.col("won").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
    keep = ["predicted_eids", "issue_tags", "runtime_seconds", "estimated_cost", "system_info", "fallback", "fired"]
    return both.select("instance_id", take("e_verdict", "verdict"), take("e_confidence", "confidence"), take("e_abstain", "abstain"), F.when(F.col("won").isNotNull(), F.coalesce("e_rationale", "rationale_short")).otherwise(F.col("rationale_short")).alias("rationale_short"), *keep)
