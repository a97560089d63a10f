"""Searches for private words, schema rules, derivation, rehearsal and exit codes."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridict.operators import construction as con
from veridict.operators import prediction, validation


def variants(spark, rows):
    return spark.createDataFrame(rows, "path string, j string").select("path", F.parse_json("j").alias("document"))


def test_a_profile_has_one_set_for_keys_and_values(spark):
    rows = [("gold.jsonl", '{"verdict": "split"}'), ("b/gold.jsonl", '{"x": "gold"}'), ("inputs.jsonl", '{"x": "gold"}'), ("p_predictions.jsonl", '{"verdict": "verdict", "y": ["gold"]}'), ("x_internal_annotation.json", '{"gold": 1}')]
    got = {(r["id"], r["profile"], r["path"], r["hit"]) for r in validation.scan_by_profile(variants(spark, rows)).collect()}
    assert got == {("gold.jsonl", "gold", "$.verdict", "value"), ("inputs.jsonl", "input", "$.x", "value"), ("p_predictions.jsonl", "prediction", "$.y[0]", "value")}


def test_rules_of_a_file(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{"glob": "*answers*", "profile": "gold", "reason": "r"}]))
    rules = validation.load_rules(str(path))
    assert validation.scan_by_profile(variants(spark, [("answers.json", '{"gold": 1}')]), rules).isEmpty()
    assert validation.scan_by_profile(variants(spark, [("gold.json", '{"gold": 1}')]), rules).count() == 1
    for broken in ([{"glob": "x"}], [{"glob": "x", "profile": "other"}]):
        path.write_text(json.dumps(broken))
        with pytest.raises(ValueError, match="rule 0"):
            validation.load_rules(str(path))


def test_deep_and_many_documents(spark):
    deep = "".join('{"a": [' for _ in range(12)) + '{"gold": "split"}' + "]}" * 12
    hits = validation.forbidden(variants(spark, [("d", deep)]).select(F.col("path").alias("id"), "document")).collect()
    assert [r["path"] for r in hits] == ["$" + ".a[0]" * 12 + ".gold"]
    many = spark.range(400_000).select("id", F.parse_json(F.when(F.col("id") % 1000 == 0, '{"a": {"split": 1}, "b": [1, 2]}').otherwise('{"a": {"x": 1}, "b": [1, 2]}')).alias("document"))
    assert validation.forbidden(many).count() == 400


def problems(spark, rule, record):
    return spark.createDataFrame([(json.dumps(record),)], "j string").select(validation.record_problems(F.parse_json("j"), rule).alias("p")).first()["p"]


def test_schema_rules(spark):
    from veridict import schemas as s

    unit = {"eid": "e1", "source_kind": "table", "modality": "text", "text": "t", "normalized_numbers": [{"value": 1, "unit": "m"}]}
    good = {"schema_version": "1", "paper_id": "p", "instance_id": "i", "claim": {"text": "c", "claim_type": "ablation", "scope": ""}, "evidence_pack": [unit], "allowed_evidence_ids": ["e1"]}
    assert problems(spark, s.INPUT_RULES, good) == []
    for change, code in (({"schema_version": 1}, "schema_version"), ({"allowed_evidence_ids": ["e1", "e1"]}, "allowed_evidence_ids"), ({"evidence_pack": []}, "evidence_pack"), ({"evidence_pack": [unit | {"gold": 1}]}, "evidence_pack"), ({"evidence_pack": [{k: v for k, v in unit.items() if k != "modality"}]}, "evidence_pack"), ({"claim": good["claim"] | {"x": 1}}, "claim: unknown key"), ({"claim": {"text": "c", "claim_type": "ablation"}}, "claim.scope"), ({"x": 1}, "unknown key"), ({"paper_id": None}, "paper_id")):
        assert problems(spark, s.INPUT_RULES, good | change) == [code]
    pred = {"instance_id": "i", "verdict": "warranted", "confidence": 0.5, "predicted_eids": [], "issue_tags": [], "abstain": False, "runtime_seconds": 1, "estimated_cost": {"gpu_seconds": 0.0, "api_cost_usd": 1}, "system_info": {"model": "m", "uses_numeric_checker": True, "uses_lora": False, "uses_vlm": False}}
    assert problems(spark, s.PREDICTION_RULES, pred) == []
    for change, code in (({"runtime_seconds": -1}, "runtime_seconds"), ({"estimated_cost": {"gpu_seconds": 0.0}}, "estimated_cost.api_cost_usd"), ({"system_info": pred["system_info"] | {"uses_vlm": 1}}, "system_info.uses_vlm"), ({"predicted_eids": [1]}, "predicted_eids"), ({"confidence": True}, "confidence")):
        assert problems(spark, s.PREDICTION_RULES, pred | change) == [code]
    note = {"schema_version": "1", "instance_id": "i", "paper": {"paper_id": "p"}, "claim": good["claim"] | {"claim_strength": "weak"}, "evidence_pack": [unit | {"is_distractor": True}], "gold": {"verdict": "warranted", "supporting_eids": [], "issue_tags": [], "severity": "minor"}, "review": {"validation_level": "team_verified"}, "stress": {"is_stress_case": False}, "split": "public_dev"}
    assert problems(spark, s.ANNOTATION_RULES, note) == [] and problems(spark, s.ANNOTATION_RULES, note | {"stress": {"stress_type": "odd"}}) == ["stress.is_stress_case", "stress.stress_type"]
    assert problems(spark, s.SYSTEM_CARD_RULES, {"system_name": "a", "team": "b", "version": "1", "other": 1}) == ["model"]
    log = dict.fromkeys(("week", "research_task", "delegated", "manually_verified", "accepted_or_rejected", "observed_failure", "lesson"), "x")
    assert problems(spark, s.DELEGATION_RULES, log | {"week": 3}) == [] and problems(spark, s.DELEGATION_RULES, log | {"week": 3.5, "lesson": None}) == ["week", "lesson"]


def private_records(spark, n=24):
    rows = []
    for k in range(n):
        seed = None if k % 3 == 0 else f"i{k - k % 3:03d}"
        rows.append({"schema_version": "1", "instance_id": f"i{k:03d}", "paper": {"paper_id": f"p{k // 6}", "provenance_ref": "x"}, "claim": {"text": f"claim {k}", "claim_type": "ablation", "scope": "s", "claim_strength": "weak"}, "evidence": [{"eid": "e1", "source_kind": "table", "modality": "text", "text": f"t {k}", "source_ref": "private"}], "gold": {"verdict": "warranted", "supporting_eids": ["e1"], "issue_tags": [], "severity": "minor"}, "stress": {"seed_instance_id": seed}})
    schema = "schema_version string, instance_id string, paper struct<paper_id: string, provenance_ref: string>, claim struct<text: string, claim_type: string, scope: string, claim_strength: string>, evidence array<struct<eid: string, source_kind: string, modality: string, text: string, normalized_numbers: array<struct<value: double, unit: string, context: string>>, source_ref: string>>, gold struct<verdict: string, supporting_eids: array<string>, issue_tags: array<string>, severity: string>, stress struct<seed_instance_id: string>"
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_derive_refuses(spark):
    records = private_records(spark)
    inputs, gold = con.derive(records)
    assert inputs.count() == gold.count() == 24 and "source_ref" not in inputs.schema.simpleString() and "severity" not in gold.schema.simpleString()
    with pytest.raises(PySparkException, match="missing field"):
        con.derive(records.withColumn("claim", F.when(F.col("instance_id") != "i003", F.col("claim"))))
    with pytest.raises(PySparkException, match="repeated key"):
        con.derive(records.unionByName(records.limit(1)))
    with pytest.raises(PySparkException, match="private field"):
        con.derive(records.withColumn("claim", F.col("claim").withField("scope", F.lit("AutoStressHidden"))))


def test_rehearsal(spark):
    def constant(inputs):
        return prediction.constant_predictor(inputs).withColumns({"predicted_eids": F.array().cast("array<string>"), "rationale_short": F.lit("r")})

    found, report = con.rehearse(private_records(spark), constant)
    assert found.isEmpty() and report["coverage"] == 1.0 and report["accuracy"] == 0.0
    assert sum(report["sizes"].values()) == 24 and report["instances"] == report["sizes"]["hidden_val"]
    found, report = con.rehearse(private_records(spark), lambda inputs: constant(inputs).where("instance_id NOT LIKE '%5'").withColumn("confidence", F.lit(2.0)), split="public")
    assert {"prediction: confidence", "prediction: missing prediction", "not scored"} <= {r["problem"] for r in found.collect()} and report["accuracy"] is None
    found, report = con.rehearse(private_records(spark), constant, by="paper", ratios={"public": 1.0})
    assert "split is empty" in {r["problem"] for r in found.collect()} and report == {}


def test_ids_are_drawn_until_labels_are_in_no_order(spark):
    old = spark.createDataFrame([(f"o{k}", "ab"[k % 2]) for k in range(12)], "instance_id string, label string")
    ids, p = con.orderly_ids(old.select(F.col("instance_id").alias("old")), old, seed=3)
    assert p >= 0.05 and ids.select("new").distinct().count() == 12
    assert con.orderly_ids(old.limit(3).select(F.col("instance_id").alias("old")), old.limit(3), seed=3)[1] is None
    first = con.new_ids(old.select(F.col("instance_id").alias("old")), seed=3)
    again = con.new_ids(old.select(F.col("instance_id").alias("old")), first.select(F.col("new").alias("instance_id")), seed=3)
    assert again.join(first, "new").isEmpty() and again.count() == 12


def test_exit_codes(spark, tmp_path):
    from veridict.sources import jsonl

    (tmp_path / "inputs.json").write_text('{"gold": 1}')
    scan = lambda: validation.scan_by_profile(jsonl.read_structured(spark, str(tmp_path)))
    assert validation.gate(scan) == 1
    (tmp_path / "inputs.json").write_text('{"claim": 1}')
    assert validation.gate(scan) == 0
    (tmp_path / "inputs.json").write_text("{")
    assert validation.gate(scan) == 2
    assert validation.gate(lambda: jsonl.read_lines(spark, str(tmp_path / "none"))) == 2


def test_only_strings_count_as_ids_and_tags(spark):
    df = spark.createDataFrame([('{"predicted_eids": [1, "e1", null, "1", "e1"], "issue_tags": [["ablation"], "caption_chart_mismatch"]}',)], "j string").select(F.parse_json("j").alias("parsed"), F.array(F.lit("e1"), F.lit("1")).alias("allowed"))
    r = prediction.normalise(df).first()
    assert (r["predicted_eids"], r["issue_tags"]) == (["e1", "1"], ["caption_chart_mismatch"])
