"""Golden values and invariants of the scorer."""

import random

import pytest

from veridict.operators import evaluation as ev
from veridict.operators import reports, selective
from veridict.plans import registry

GOLD = "instance_id string, verdict string, supporting_eids array<string>, issue_tags array<string>"
PRED = "instance_id string, verdict string, confidence double, abstain boolean, predicted_eids array<string>, issue_tags array<string>, runtime_seconds double, gpu_seconds double, api_cost_usd double"


def frames(spark, rows):
    """(gold, said, confidence, abstain) per row."""
    gold = spark.createDataFrame([(f"i{k:03d}", g, ["e1"], []) for k, (g, *_) in enumerate(rows)], GOLD)
    pred = spark.createDataFrame([(f"i{k:03d}", s, c, a, ["e1"], [], None, None, None) for k, (_, s, c, a) in enumerate(rows)], PRED)
    return gold, pred


def areas(spark, rows):
    units = selective.units(*frames(spark, rows))
    r = selective.areas(units).first()
    assert tuple(r) == tuple(selective.summary(selective.curve(units)).first())
    return r["aurc"], r["augrc"], r["aurc_voluntary"]


def test_all_wrong_is_not_rewarded(spark):
    assert areas(spark, [("warranted", "overclaimed", 1.0, False)] * 10)[:2] == (1.0, 0.55)


def test_all_right_is_zero(spark):
    assert areas(spark, [("warranted", "warranted", 0.5, False)] * 4) == (0.0, 0.0, 0.0)


def test_abstentions_are_errors_at_the_end(spark):
    rows = [("warranted", "warranted", 0.9, False)] * 2 + [("warranted", "warranted", 0.9, True)] * 2
    points = selective.curve(selective.units(*frames(spark, rows)))
    assert areas(spark, rows)[2] == 0.0
    assert selective.risk_at(points, (1.0,)).first()["risk"] == 0.5


def test_a_severe_answer_covers_nothing(spark):
    rows = [("overclaimed", "warranted", 0.9, False)] + [("overclaimed", "warranted", 0.9, True)] * 2
    assert selective.coverage_at(selective.curve(selective.units(*frames(spark, rows))), (0.0,)).first()["coverage"] == 0.0


def test_curve_against_its_definition(spark):
    rng = random.Random(3)
    verdicts = ["warranted", "overclaimed", "contradicted", "insufficient"]
    rows = [(rng.choice(verdicts), rng.choice(verdicts), rng.choice([0.1, 0.2, 0.25, 0.9, 1.0]), rng.random() < 0.2) for _ in range(150)]
    units = sorted(((not a, c if not a else float("-inf"), int(a or g != s), int(not a and g != "warranted" and s == "warranted"), int(g != "warranted")) for g, s, c, a in rows), key=lambda u: (-u[0], -u[1]))
    want, base, at = [], [0, 0, 0], 0
    while at < len(units):
        tie = [u for u in units[at:] if u[1] == units[at][1]]
        sums = [sum(u[i] for u in tie) for i in (2, 3, 4)]
        for step in range(1, len(tie) + 1):
            e, s, r = (b + step / len(tie) * x for b, x in zip(base, sums))
            want.append((at + step, e / (at + step), e / len(units), s / r if r else 0.0))
        base, at = [b + x for b, x in zip(base, sums)], at + len(tie)
    got = sorted((p["k"], p["risk"], p["generalized"], p["sfwr"]) for p in selective.curve(selective.units(*frames(spark, rows))).collect())
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-12)


def test_calibration(spark):
    rows = ev.answered(*frames(spark, [("warranted", "warranted", 0.8, False)] * 8 + [("warranted", "overclaimed", 0.8, False)] * 2))
    assert ev.ece(rows).first()["ece"] == 0
    assert ev.brier(rows).first()["brier"] == pytest.approx(0.8 * 0.04 + 0.2 * 0.64)


def test_nothing_answered(spark):
    gold, pred = frames(spark, [("warranted", "warranted", 0.5, True)] * 2)
    r = ev.accuracy(ev.answered(gold, pred)).first()
    assert (r["answered"], r["accuracy"], r["macro_f1"]) == (0, 0.0, 0.0)
    assert areas(spark, [("warranted", "warranted", 0.5, True)] * 2)[0] == 1.0


def test_rare_tags_top_the_missed_and_sets_ignore_repeats(spark):
    rows = spark.createDataFrame([(["a"], ["a", "a"])] * 9 + [(["b"], None)], "gold_tags array<string>, issue_tags array<string>")
    assert [tuple(r) for r in ev.most_missed(rows).collect()] == [("b", 1)]
    assert tuple(ev.set_prf(rows, "gold_tags", "issue_tags").first())[:3] == (9, 0, 1)


def test_a_partial_submission_is_not_scored(spark, tmp_path):
    gold, pred = frames(spark, [("warranted", "warranted", 0.5, False)] * 3)
    full = reports.score(gold, pred)
    assert reports.write_report(full, str(tmp_path / "m.json"), str(tmp_path / "m.md")) == 0 and full.first()["accuracy"] == 1.0
    part = reports.score(gold, pred.where("instance_id <> 'i001'"))
    assert part.first()["accuracy"] is None and reports.write_report(part, str(tmp_path / "m.json")) == 1


def test_flagship_golden_values(spark):
    r = registry.QUERIES["w4_aurc"](spark, "/root/testdata/sf0.01").first()
    assert (r["aurc"], r["augrc"]) == (pytest.approx(0.278562935), pytest.approx(0.14195908))


def test_one_confidence_for_all_rows(spark, monkeypatch):
    """A tie of all rows is dealt out in ranges, and its points, ranks and areas are those of the definition."""
    from veridict.sources import tables

    monkeypatch.setattr(tables, "AT_ONCE", 100)
    rows = [("warranted", "warranted" if k % 4 else "overclaimed", 0.5, False) for k in range(1234)]
    units = selective.units(*frames(spark, rows))
    points = selective.curve(units)
    assert points.rdd.getNumPartitions() > 1 and sorted(p["k"] for p in points.collect()) == list(range(1, 1235))
    got = selective.areas(units).first()
    assert got["aurc"] == pytest.approx(309 / 1234, abs=1e-9) and tuple(got) == tuple(selective.summary(points).first())
    ranks = selective.rank(units).collect()
    assert [r["instance_id"] for r in sorted(ranks, key=lambda r: r["place"])] == sorted(r["instance_id"] for r in ranks)
    assert sorted(r["place"] for r in ranks) == list(range(1, 1235))


def test_harmonic_numbers(spark):
    from pyspark.sql import functions as F

    got = {r["n"]: r["h"] for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 64, 65, 1000, 100_000)], "n long").select("n", selective.harmonic(F.col("n")).alias("h")).collect()}
    for n, h in got.items():
        assert h == pytest.approx(sum(1 / i for i in range(1, n + 1)), abs=1e-11)


def test_the_full_report(spark, tmp_path):
    rng = random.Random(4)
    verdicts = ["warranted", "overclaimed", "contradicted", "insufficient"]
    rows = [(rng.choice(verdicts), rng.choice(verdicts[1:]), rng.random(), rng.random() < 0.2) for _ in range(60)]
    gold, pred = frames(spark, rows)
    stress = spark.createDataFrame([(f"i{k:03d}", k % 2 == 0, "a" if k % 4 else "b") for k in range(50)], "instance_id string, is_stress_case boolean, stress_type string")
    found = reports.report(gold, pred, stress, budget=10.0)
    one = reports.score(gold, pred, 10.0).first()
    for name, value in (("accuracy", found["verdict"]["accuracy"]), ("macro_f1", found["verdict"]["macro_f1"]), ("sfwr", found["severe_false_warrants"]["rate"]), ("ece", found["calibration"]["ece"]), ("aurc", found["selective_risk"]["aurc"]), ("composite", found["composite"]["composite"])):
        assert value == one[name]
    assert [c["class"] for c in found["classes"]] == sorted(verdicts) and sum(sum(r.values()) for r in found["confusion_matrix"].values()) == found["coverage"]["answered"]
    assert len(found["composite"]["notes"]) == 3 - 1 + (found["composite"]["issue_f1"] is None)  # no warranted answer, no cost reported
    assert {(s["slice"], s["kind"]) for s in found["stress"]["slices"]} == {("clean", "all"), ("stress", "all"), ("stress", "a"), ("stress", "b")}
    assert reports.write_report(found, str(tmp_path / "r.json"), str(tmp_path / "r.md")) == 0
    text = (tmp_path / "r.md").read_text()
    assert "## Confusion matrix" in text and "### Slices" in text and "full by construction" in text
    part = reports.report(gold, pred.limit(3))
    assert part["verdict"] is None and part["submission"]["missing"] == 57 and reports.write_report(part, str(tmp_path / "p.json"), str(tmp_path / "p.md")) == 1
