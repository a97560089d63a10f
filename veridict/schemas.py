"""Record schemas, label sets and key sets of the audit data."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the data format.
VERDICTS = ("warranted", "overclaimed", "contradicted", "insufficient")
CLAIM_TYPES = ("numerical_performance", "baseline_superiority", "ablation", "robustness", "efficiency", "bounded_generalization")
ISSUE_TAGS = ("numerical_inconsistency", "claim_stronger_than_evidence", "unsupported_generalization", "missing_ablation_support", "non_comparable_baseline", "weak_statistical_support", "evidence_missing_or_incomplete", "caption_chart_mismatch")
FORBIDDEN_KEYS = (
    "gold", "gold_verdict", "verdict", "expected_verdict", "supporting_eids", "severity",
    "stress", "stress_type", "transformation_type", "is_stress_case", "seed_instance_id", "evidence_removal", "scope_expansion", "numeric_perturbation", "distractor_flag",
    "private_rationale", "rationale_private", "review", "review_note", "human_verification_note", "validation_level", "reviewer", "adjudication_note", "TA_note",
    "provenance", "provenance_map", "provenance_ref", "source_url", "source_ref", "source_location", "paper_title", "authors", "venue", "license_status", "is_distractor",
    "split", "private_slice", "GoldHidden", "AutoStressHidden", "ChallengeHidden",
)
STRESS_TYPES = ("claim_strengthening", "scope_expansion", "evidence_removal", "distractor_insertion", "numerical_perturbation", "evidence_reordering", "caption_chart_mismatch", "non_comparable_baseline_trap", "missing_ablation_trap", "weak_statistical_support_trap")
SEVERITIES = ("minor", "moderate", "severe")
CLAIM_STRENGTHS = ("weak", "moderate", "strong")
VALIDATION_LEVELS = ("auto_unchecked", "team_verified", "ta_validated", "ta_adjudicated")
SPLITS = ("public_warmup", "public_dev", "hidden_val_1", "hidden_val_2", "gold_hidden", "auto_stress_hidden", "challenge_hidden", "silver_pool")
PUBLIC_CLAIM_FIELDS = ("text", "claim_type", "scope")
PUBLIC_EVIDENCE_FIELDS = ("eid", "source_kind", "modality", "text", "normalized_numbers")

NUMBER = "STRUCT<value: DOUBLE, unit: STRING, context: STRING>"
EVIDENCE = f"STRUCT<eid: STRING, source_kind: STRING, modality: STRING, text: STRING, normalized_numbers: ARRAY<{NUMBER}>>"
INPUT = f"schema_version STRING, paper_id STRING, instance_id STRING, claim STRUCT<text: STRING, claim_type: STRING, scope: STRING>, evidence_pack ARRAY<{EVIDENCE}>, allowed_evidence_ids ARRAY<STRING>"
GOLD = "instance_id STRING, gold STRUCT<verdict: STRING, supporting_eids: ARRAY<STRING>, issue_tags: ARRAY<STRING>>"
PREDICTION = "instance_id STRING, verdict STRING, confidence DOUBLE, predicted_eids ARRAY<STRING>, issue_tags ARRAY<STRING>, abstain BOOLEAN, rationale_short STRING, runtime_seconds DOUBLE, estimated_cost STRUCT<gpu_seconds: DOUBLE, api_cost_usd: DOUBLE>, system_info STRUCT<model: STRING, uses_numeric_checker: BOOLEAN, uses_lora: BOOLEAN, uses_vlm: BOOLEAN>"


@dataclass(frozen=True)
class Text:
    """A string of ``least`` to ``most`` characters, or one of a list; ``or_integer`` allows a whole number too."""

    least: int = 0
    most: int = 0
    one_of: tuple[str, ...] = ()
    or_integer: bool = False


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Flag:
    pass


@dataclass(frozen=True)
class ListOf:
    of: object
    least: int = 0
    unique: bool = False


@dataclass(frozen=True)
class Record:
    """Fields by name, each with its rule and whether it is required; a closed record has no others."""

    fields: dict
    closed: bool = True


def _all(required: dict, optional: dict | None = None, closed: bool = True) -> Record:
    return Record({k: (v, True) for k, v in required.items()} | {k: (v, False) for k, v in (optional or {}).items()}, closed)


# Fixed values of the data format: what each kind of record must and may have.
FILLED = Text(least=1)
NUMBERS = ListOf(_all({}, {"value": Number(), "unit": Text(), "context": Text()}))
UNIT = {"eid": FILLED, "source_kind": Text(), "modality": Text(), "text": Text()}
CLAIM = {"text": FILLED, "claim_type": Text(one_of=CLAIM_TYPES), "scope": Text()}
TAGS = ListOf(Text(one_of=ISSUE_TAGS))
INPUT_RULES = _all({
    "schema_version": Text(), "paper_id": FILLED, "instance_id": FILLED, "claim": _all(CLAIM),
    "evidence_pack": ListOf(_all(UNIT, {"normalized_numbers": NUMBERS}), least=1), "allowed_evidence_ids": ListOf(FILLED, least=1, unique=True),
})
PREDICTION_RULES = _all(
    {"instance_id": FILLED, "verdict": Text(one_of=VERDICTS), "confidence": Number(0.0, 1.0), "predicted_eids": ListOf(Text()), "issue_tags": TAGS},
    {
        "abstain": Flag(), "rationale_short": Text(most=600), "runtime_seconds": Number(0.0), "estimated_cost": _all({"gpu_seconds": Number(0.0), "api_cost_usd": Number(0.0)}),
        "system_info": _all({"model": Text(), "uses_numeric_checker": Flag(), "uses_lora": Flag(), "uses_vlm": Flag()}),
    },
)
ANNOTATION_RULES = _all(
    {
        "schema_version": Text(), "instance_id": FILLED, "paper": _all({"paper_id": FILLED}, {"provenance_ref": Text(), "domain": Text(), "year_bucket": Text()}),
        "claim": _all(CLAIM, {"claim_strength": Text(one_of=CLAIM_STRENGTHS), "source_location": Text()}),
        "evidence_pack": ListOf(_all(UNIT, {"source_ref": Text(), "is_distractor": Flag(), "normalized_numbers": NUMBERS}), least=1),
        "gold": _all({"verdict": Text(one_of=VERDICTS), "supporting_eids": ListOf(Text()), "issue_tags": TAGS}, {"severity": Text(one_of=SEVERITIES), "private_rationale": Text()}),
        "review": _all({"validation_level": Text(one_of=VALIDATION_LEVELS)}, {"reviewer": Text(), "review_note": Text(), "human_verification_note": Text()}),
    },
    {"stress": _all({"is_stress_case": Flag()}, {"stress_type": Text(one_of=STRESS_TYPES), "seed_instance_id": Text()}), "split": Text(one_of=SPLITS)},
)
SYSTEM_CARD_RULES = _all(
    {"system_name": Text(), "team": Text(), "version": Text(), "model": Text()},
    {"retrieval_method": Text(), "uses_numeric_checker": Flag(), "uses_fine_tuning": Flag(), "uses_vlm": Flag(), "intended_use": Text(), "non_intended_use": Text(), "known_failure_modes": Text()},
    closed=False,
)
DELEGATION_RULES = _all({"week": Text(or_integer=True), "research_task": Text(), "delegated": Text(), "manually_verified": Text(), "accepted_or_rejected": Text(), "observed_failure": Text(), "lesson": Text()}, closed=False)
