"""The auditing run with models that answer, babble, come round or fail."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridict.operators import auditing, leakage, validation
from veridict.sources import models

SCHEMA = "instance_id string, claim string, pack array<struct<eid:string,text:string,normalized_numbers:array<struct<value:double,unit:string,context:string>>>>, allowed array<string>"


def instances(spark):
    return spark.createDataFrame([
        ("a", "Our model outperforms all baselines.", [("e1", "Our model = 5.0, Competitor = 6.0", None), ("e2", "A note on colours", None)], ["e1", "e2"]),
        ("b", "Pruning halves memory.", [("e1", "Memory is halved by pruning", None), ("e2", "Unrelated", None)], []),
        ("c", "Nothing is known.", [], None),
    ], SCHEMA)


def good(prompt):
    return "Well: " + json.dumps({"verdict": "warranted", "confidence": 0.95, "predicted_eids": ["e1", "e9"], "issue_tags": []})


def test_one_pass(spark):
    got = {r["instance_id"]: r for r in auditing.audit(instances(spark), auditing.whole_pack, auditing.calls(good), "m").collect()}
    assert [got[i]["verdict"] for i in "abc"] == ["warranted"] * 3 and got["a"]["predicted_eids"] == ["e1"] and got["c"]["predicted_eids"] == []
    assert got["a"]["system_info"]["model"] == "m" and not got["a"]["system_info"]["uses_numeric_checker"] and not any(r["fallback"] for r in got.values())
    records = auditing.audit(instances(spark), auditing.whole_pack, auditing.calls(good), "m").drop("fallback")
    assert records.select(validation.prediction_problems(F.parse_json(F.to_json(F.struct("*")))).alias("p")).where("size(p) > 0").isEmpty()


def test_the_tool_corrects_but_never_fallbacks(spark):
    mixed = lambda p: good(p) if "[failed]" in p else "no idea" if "Pruning" in p else good(p)
    got = {r["instance_id"]: r for r in auditing.audit(instances(spark), auditing.whole_pack, auditing.calls(mixed), "m", tool=auditing.numeric_tool()).collect()}
    assert (got["a"]["verdict"], got["a"]["issue_tags"]) == ("contradicted", ["numerical_inconsistency"])
    assert got["b"]["fallback"] and got["b"]["abstain"] and (got["b"]["verdict"], got["b"]["confidence"]) == ("insufficient", 0.0)


@pytest.mark.parametrize("retries", [0, 1, 2])
def test_unreadable_replies_are_asked_again(spark, retries):
    asked = []

    def model(prompts):
        asked.append(sorted(r["instance_id"] for r in prompts.collect()))
        text = F.when((F.col("instance_id") == "b") & F.lit(len(asked) < 3), "?").otherwise(good(""))
        return prompts.select("instance_id", text.alias("reply"), F.lit(1.0).alias("runtime_seconds"))

    got = {r["instance_id"]: r for r in auditing.audit(instances(spark), auditing.by_bm25(1), model, "m", retries=retries).collect()}
    assert asked == [["a", "b", "c"], ["b"], ["b"]][: retries + 1]
    assert got["b"]["fallback"] == (retries < 2) and got["b"]["runtime_seconds"] == retries + 1


def test_bm25_picks_and_repeats_are_refused(spark):
    units = {r["instance_id"]: [u["eid"] for u in r["units"]] for r in auditing.by_bm25(1)(instances(spark)).collect()}
    assert units == {"a": ["e1"], "b": ["e1"], "c": []}
    with pytest.raises(PySparkException, match="repeated instance_id"):
        auditing.audit(instances(spark).unionByName(instances(spark)), auditing.whole_pack, auditing.calls(good), "m")


def test_votes(spark):
    passes = []

    def model(prompts):
        passes.append(1)
        n = len(passes)
        say = lambda v, c: json.dumps({"verdict": v, "confidence": c, "predicted_eids": ["e1"], "issue_tags": [], "rationale_short": f"pass {n}"})
        reply = F.when(F.col("instance_id") == "c", "nothing").when(F.col("instance_id") == "b", say("overclaimed" if n == 1 else "warranted", 1.0)).otherwise(say("warranted", 1.0))
        return prompts.select("instance_id", reply.alias("reply"), F.lit(1.0).alias("runtime_seconds"))

    got = {r["instance_id"]: r for r in auditing.audit_by_votes(instances(spark), auditing.whole_pack, model, "m", retries=0).collect()}
    assert got["a"]["fired"] == ["checker_conflict"] and got["a"]["abstain"] and got["a"]["verdict"] == "insufficient"
    assert (got["b"]["verdict"], got["b"]["confidence"], got["b"]["abstain"], got["b"]["rationale_short"], got["b"]["predicted_eids"]) == ("warranted", 0.6667, False, "pass 2", ["e1"])
    assert got["c"]["fired"] == ["unparsable_json"] and got["c"]["fallback"] and "could not be parsed" in got["c"]["rationale_short"]


def test_retries_of_the_endpoint(monkeypatch):
    import io
    import urllib.error
    import urllib.request

    waits, answers = [], [urllib.error.HTTPError("u", 503, "busy", {}, None), urllib.error.URLError("gone"), json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode()]

    def answer(request, timeout):
        found = answers.pop(0)
        if isinstance(found, Exception):
            raise found
        return io.BytesIO(found)

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    assert models.http_model("http://x", "m", sleep=waits.append)("p") == "hi" and waits == [1.0, 2.0]
    answers.append(urllib.error.HTTPError("u", 401, "no", {}, None))
    with pytest.raises(models.ModelError, match="401"):
        models.http_model("http://x", "m", sleep=waits.append)("p")
    answers.append(json.dumps({"choices": [{"finish_reason": "length", "message": {"content": "cut"}}]}).encode())
    with pytest.raises(models.ModelError, match="cut off"):
        models.http_model("http://x", "m")("p")


def test_leave_one_out_takes_any_classifier(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], f"{'x' if k % 2 else 'y'}{k}") for k in range(12)], "instance_id int, label string, text string")

    def fit(train):
        first = {t[0]: y for t, y in zip(train["text"], train["label"])}
        return lambda row: first.get(row["text"][0], "?")

    got = leakage.leave_one_out(rows, fit).collect()
    assert len(got) == 12 and all(r["predicted"] == r["label"] for r in got)


def test_metadata_probe(spark):
    labels = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(16)], "instance_id int, label string")
    leak = labels.selectExpr("instance_id", "'length' AS name", "CAST(label = 'a' AS DOUBLE) AS value")
    found = leakage.metadata_probe(leak, labels, permutations=9).first()
    assert found["observed"] == 1.0 and found["p"] == 0.1 and found["most"] < 1.0
