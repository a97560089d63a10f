"""Predictions: recovery from prose, validity, normalisation, fallbacks, rule predictors, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridict.schemas import ISSUE_TAGS, VERDICTS

# Fixed values of the prediction format.
FALLBACK_VERDICT = "insufficient"
FALLBACK_RATIONALE = "Safe fallback: the model output could not be parsed."
DEFAULT_RATIONALE = "Normalized structured prediction."
RATIONALE_CHARS = 500
CONSTANT = ("insufficient", 0.25, "evidence_missing_or_incomplete")
QUANTIFIERS = r"\b(all|every|consistently|always|any)\b"


def recover_json(reply: Column) -> Column:
    """A JSON object as VARIANT: the whole reply, else its widest ``{...}``; null if neither parses to an object."""
    whole = F.try_parse_json(reply)
    part = F.try_parse_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))
    is_object = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    return F.coalesce(is_object(whole), is_object(part))


def kind(value: Column, path: str) -> Column:
    """Type name of a field of a VARIANT; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def is_number(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))


def is_list(value: Column, path: str) -> Column:
    return F.coalesce(kind(value, path).startswith("ARRAY"), F.lit(False))


def strings(value: Column, path: str) -> Column:
    """The strings of a list, other elements dropped; anything else is an empty list."""
    items = F.filter(F.try_variant_get(value, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(items, lambda x: F.variant_get(x, "$", "string")), F.array().cast("array<string>"))


def problems(value: Column) -> Column:
    """Codes of what makes a raw prediction (VARIANT) invalid for scoring; empty if nothing does."""
    confidence = F.try_variant_get(value, "$.confidence", "double")
    verdict = F.when(kind(value, "$.verdict") == "STRING", F.try_variant_get(value, "$.verdict", "string"))
    # a JSON true counts as the number one here, as it does for the scorer
    numeric = is_number(value, "$.confidence") | (kind(value, "$.confidence") == "BOOLEAN")
    found = F.array(
        F.when(kind(value, "$.instance_id").isNull(), "no instance_id"),
        F.when(~F.coalesce(verdict.isin(*VERDICTS), F.lit(False)), "verdict"),
        F.when(~F.coalesce(numeric & ((kind(value, "$.confidence") == "BOOLEAN") | confidence.between(0.0, 1.0)), F.lit(False)), "confidence"),
        F.when(~is_list(value, "$.predicted_eids"), "predicted_eids"),
        F.when(~is_list(value, "$.issue_tags"), "issue_tags"),
        F.when(kind(value, "$.abstain").isNotNull() & (kind(value, "$.abstain") != "BOOLEAN"), "abstain"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def normalise(rows: DataFrame, value: str = "parsed", allowed: str = "allowed") -> DataFrame:
    """A VARIANT reply to a valid prediction, whatever it has: unknown verdicts, types, eids and tags are mended."""
    v = F.col(value)
    verdict = F.when(kind(v, "$.verdict") == "STRING", F.try_variant_get(v, "$.verdict", "string"))
    number = F.when(is_number(v, "$.confidence"), F.try_variant_get(v, "$.confidence", "double"))
    rationale = F.when(kind(v, "$.rationale_short") == "STRING", F.trim(F.try_variant_get(v, "$.rationale_short", "string")))
    tags = F.array(*[F.lit(t) for t in ISSUE_TAGS])
    return rows.select(
        *[c for c in rows.columns if c not in (value, allowed)],
        F.when(verdict.isin(*VERDICTS), verdict).otherwise(FALLBACK_VERDICT).alias("verdict"),
        F.least(F.greatest(F.coalesce(number, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.array_distinct(F.filter(strings(v, "$.predicted_eids"), lambda e: F.array_contains(allowed, e))).alias("predicted_eids"),
        F.array_distinct(F.filter(strings(v, "$.issue_tags"), lambda t: F.array_contains(tags, t))).alias("issue_tags"),
        F.coalesce(F.when(kind(v, "$.abstain") == "BOOLEAN", F.try_variant_get(v, "$.abstain", "boolean")), F.lit(False)).alias("abstain"),
        F.left(F.coalesce(F.nullif(rationale, F.lit("")), F.lit(DEFAULT_RATIONALE)), F.lit(RATIONALE_CHARS)).alias("rationale_short"),
    )


def fallback_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("rationale_short") == FALLBACK_RATIONALE).alias("fallbacks"), F.count(F.lit(1)).alias("total"))


def with_fallback(rows: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Where nothing was parsed: insufficient, confidence zero, abstained, a fixed rationale."""
    gone = F.col(parsed).isNull()
    out = rows
    for name, value in (("verdict", F.lit(FALLBACK_VERDICT)), ("confidence", F.lit(0.0)), ("abstain", F.lit(True)), ("rationale_short", F.lit(FALLBACK_RATIONALE))):
        out = out.withColumn(name, F.when(gone, value).otherwise(F.col(name)))
    return out


def constant_predictor(rows: DataFrame) -> DataFrame:
    verdict, confidence, tag = CONSTANT
    return rows.select("instance_id", F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"), F.array(F.lit(tag)).alias("issue_tags"), F.lit(False).alias("abstain"))


def rule_predictor(rows: DataFrame, text: str = "text", eids: str = "eids") -> DataFrame:
    """A rule that stands for a model: universal claims over several units are overclaims."""
    n, universal = F.size(eids), F.lower(text).rlike(QUANTIFIERS)
    pick = lambda none, many, one, other: F.when(n == 0, none).when(universal & (n >= 2), many).when(universal, one).otherwise(other)
    none = F.array().cast("array<string>")
    return rows.select(
        "instance_id",
        pick(F.lit("insufficient"), F.lit("overclaimed"), F.lit("insufficient"), F.lit("warranted")).alias("verdict"),
        pick(F.lit(0.2), F.lit(0.7), F.lit(0.3), F.lit(0.6)).alias("confidence"),
        pick(none, F.slice(eids, 1, 2), F.slice(eids, 1, 1), F.slice(eids, 1, 1)).alias("predicted_eids"),
        (n == 0).alias("abstain"),
    )


def prompt(claim: Column, units: Column) -> Column:
    """Claim, ``- eid: text`` lines and the sorted tag vocabulary."""
    lines = F.array_join(F.transform(units, lambda u: F.concat(F.lit("- "), u["eid"], F.lit(": "), u["text"])), "\n")
    return F.concat(F.lit("Claim: "), claim, F.lit("\nEvidence:\n"), lines, F.lit("\nIssue tags: " + ", ".join(sorted(ISSUE_TAGS))))


def parse_prompt(text: Column) -> Column:
    """Back from a prompt: struct(claim, eids)."""
    return F.struct(F.regexp_extract(text, r"(?s)^Claim: (.*?)\nEvidence:", 1).alias("claim"), F.regexp_extract_all(text, F.lit(r"(?m)^- ([^:\n]+):"), F.lit(1)).alias("eids"))
