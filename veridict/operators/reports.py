"""The scoring run as a whole: one row of metrics, the full report, and their Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridict.operators import evaluation as ev
from veridict.operators import selective as sel


def score(gold: DataFrame, pred: DataFrame, budget: float | None = None) -> DataFrame:
    """One row: gate, coverage, and, where the submission can be scored, the quality metrics (else null).

    The gate is read first: a submission that fails it costs no more than its id joins.
    """
    gate = ev.gate(gold, pred)
    base = gate.join(F.broadcast(ev.coverage(gold, pred)))
    metrics = ("accuracy", "macro_f1", "evidence_f1", "sfwr", "brier", "ece", "aurc", "augrc", "composite")
    if not gate.first()["scoreable"]:
        return base.select("*", *[F.lit(None).cast("double").alias(m) for m in metrics])
    rows = ev.answered(gold, pred)
    one = [
        ev.accuracy(rows).select("accuracy", "macro_f1"),
        ev.set_prf(rows, "supporting_eids", "predicted_eids").select(F.col("f1").alias("evidence_f1")),
        ev.severe_false_warrants(rows).select(F.col("rate").alias("sfwr")),
        ev.brier(rows),
        ev.ece(rows),
        sel.summary(sel.curve(sel.units(gold, pred))).select("aurc", "augrc"),
        ev.composite(rows, pred, budget).select("composite"),
    ]
    for part in one:
        base = base.join(F.broadcast(part))  # one row each
    return base


def report(gold: DataFrame, pred: DataFrame, stress: DataFrame | None = None, budget: float | None = None) -> dict:
    """All sections of a scoring run as one nested dict. What comes to the driver are tables of fixed domains (classes,
    bins, levels, kinds of stress, tags); ids are counted, not listed. Sections of quality are null where the submission
    cannot be scored."""
    rows_of = lambda df, *order: [r.asDict() for r in df.orderBy(*order).collect()]
    one = lambda df: df.first().asDict()
    gate = one(ev.gate(gold, pred))
    out = {
        "submission": gate,
        "systems": [r["model"] for r in rows_of(ev.systems(pred), "model")] if "model" in pred.columns else [],
        "counts": {"gold_instances": gold.count(), "predictions_submitted": pred.count(), "abstained": pred.where("abstain").count()},
        "coverage": one(ev.coverage(gold, pred)),
        "abstention_by_gold_verdict": rows_of(ev.abstention(gold, pred), "gold"),
    }
    sections = ("verdict", "classes", "confusion_matrix", "evidence", "issue_tags", "severe_false_warrants", "calibration", "selective_risk", "stress", "cost", "composite")
    if not gate["scoreable"]:
        return out | dict.fromkeys(sections)
    rows = ev.answered(gold, pred)
    units = sel.units(gold, pred)
    points = sel.curve(units)
    tags = rows_of(ev.tag_prf(rows), "tag")
    out["verdict"], out["classes"] = one(ev.accuracy(rows)), rows_of(ev.verdict_prf(rows), "class")
    out["confusion_matrix"] = {r.pop("gold"): r for r in rows_of(ev.confusion(rows), "gold")}
    out["evidence"] = one(ev.set_prf(rows, "supporting_eids", "predicted_eids"))
    out["issue_tags"] = one(ev.set_prf(rows, "gold_tags", "issue_tags")) | {"tags": tags, "macro_f1": sum(t["f1"] for t in tags) / len(tags) if tags else None, "most_missed": [r.asDict() for r in ev.most_missed(rows).collect()]}
    out["severe_false_warrants"] = one(ev.severe_false_warrants(rows))
    out["calibration"] = one(ev.brier(rows)) | one(ev.ece(rows)) | {"bins": rows_of(ev.ece_bins(rows), "bin")}
    out["selective_risk"] = one(sel.areas(units)) | {"at_fixed_coverage": rows_of(sel.risk_at(points), "level"), "coverage_at_sfwr": rows_of(sel.coverage_at(points), "target")}
    out["stress"] = None
    if stress is not None:
        out["stress"] = {"slices": rows_of(ev.slices(rows, stress), "slice", "kind"), "degradation": one(ev.degradation(rows, stress)), "abstention": rows_of(ev.abstention_by_stress(gold, pred, stress), "kind")}
    out["cost"] = one(ev.cost(pred, budget)) | {"budget": budget}
    out["composite"] = one(ev.composite(rows, pred, budget)) | {"weights": dict(ev.WEIGHTS)}
    out["composite"]["notes"] = composite_notes(out)
    return out


def composite_notes(found: dict) -> list[str]:
    """What has to be said beside the composite: terms that are missing, or full by construction."""
    notes, composite = [], found["composite"]
    warranted = next((c for c in found["classes"] if c["class"] == "warranted"), None)
    if warranted and warranted["tp"] + warranted["fp"] == 0:
        notes.append("no answer is warranted, so the safety term is full by construction: a property of the behaviour, not of quality")
    if composite["cost"] is None:
        notes.append("the cost term is missing: there is no budget to hold it against")
    elif not found["cost"]["gpu_seconds"] and not found["cost"]["api_cost_usd"]:
        notes.append("no cost was reported, so the cost term is full for everyone and compares nothing")
    covered = sum(w for c, w in ev.WEIGHTS.items() if composite[c] is not None)
    if covered < 1 - 1e-9:
        notes.append(f"terms of {covered:.2f} of 1.00 are there; the score is over these and does not compare with a full one")
    return notes


def _cell(value) -> str:
    return "-" if value is None else f"{value:.6g}" if isinstance(value, float) else ", ".join(map(str, value)) if isinstance(value, list) else str(value)


def _lines(value, title: str, level: int) -> list[str]:
    """A heading, the plain entries as a list, lists of records as tables, and what is nested below further headings."""
    out = ["", f"{'#' * level} {title.replace('_', ' ').capitalize()}", ""]
    if value is None:
        return [*out, "not scored"]
    if isinstance(value, list) and value and isinstance(value[0], dict):
        names = list(value[0])
        return [*out, "| " + " | ".join(names) + " |", "|-" * len(names) + "|", *("| " + " | ".join(_cell(r[n]) for n in names) + " |" for r in value)]
    if not isinstance(value, dict):
        return [*out, _cell(value)]
    nested = {k: v for k, v in value.items() if isinstance(v, dict) or (isinstance(v, list) and v and isinstance(v[0], dict))}
    out += [f"- {k.replace('_', ' ')}: {_cell(v)}" for k, v in value.items() if k not in nested]
    for k, v in nested.items():
        out += _lines(v, k, level + 1)
    return out


def report_markdown(found: dict) -> str:
    lines = ["# Scores"]
    if not found["submission"]["scoreable"]:
        lines += ["", "The submission is not scored: it needs just one valid prediction for each gold instance. Doubt is said by `abstain`, not by leaving a line out."]
    for name, value in found.items():
        lines += _lines(value, name, 2)
    return "\n".join(lines) + "\n"


def markdown(row: dict) -> str:
    lines = ["# Scores", "", "| metric | value |", "|-|-|"]
    lines += [f"| {k} | {'not scored' if v is None else f'{v:.6g}' if isinstance(v, float) else v} |" for k, v in row.items()]
    return "\n".join(lines) + "\n"


def write_report(scored: DataFrame | dict, json_path: str, markdown_path: str | None = None) -> int:
    """Writes the row of ``score`` or the dict of ``report``; returns 0 if the submission could be scored and 1 if not."""
    found = scored if isinstance(scored, dict) else scored.first().asDict()
    with open(json_path, "w", encoding="utf-8") as out:
        json.dump(found, out, ensure_ascii=False, indent=2)
    if markdown_path:
        with open(markdown_path, "w", encoding="utf-8") as out:
            out.write(report_markdown(found) if isinstance(scored, dict) else markdown(found))
    return 0 if (found["submission"] if isinstance(scored, dict) else found)["scoreable"] else 1
