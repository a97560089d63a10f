"""Claims, evidence and the status that must come out."""

import pytest

from veridict.operators import numeric

ROWS = ["Noise corruption, recall lost per model: P = 12.5, Q = 14.1", "Blur corruption, recall lost per model: P = 4.0, Q = 6.2", "Crop corruption, recall lost per model: P = 9.0, Q = 9.3"]
PARSERS = ["Proposed parser = 71.5, previous parser = 67.5"]
FOLDS = ["Fold one = 51.0", "Fold two = 53.0"]
SLOW = ["Latency (lower is better): Our model = 12.5, Competitor = 20.0."]
CASES = [
    ("Our model outperforms all baselines.", ["Our model = 61.4, Standard tagger = 63.0"], ["failed"]),
    ("Our model outperforms all baselines.", ["Ablated variant = 55.0, Our model = 58.5, Competitor = 57.0"], ["ok"]),
    ("Our model outperforms all baselines.", ["The appendix lists hyperparameters."], ["unknown"]),
    ("The proposed parser reaches 74.5 on TreeBank Z.", ["TreeBank Z score: proposed parser = 71.2, previous parser = 70.0."], ["failed"]),
    ("The proposed parser improves the score by 4 percentage points.", PARSERS, ["ok"]),
    ("The proposed parser improves the score by 4%.", PARSERS, ["failed"]),
    ("The average score is 52.0.", FOLDS, ["ok"]),
    ("The average score is 52.6.", FOLDS, ["failed"]),
    ("Our model obtains the highest recall.", ["Our model = 40.5, Competitor = 47.25"], ["failed"]),
    ("Our model obtains the highest recall.", ["Our model = 49.5, Competitor = 47.25"], ["ok"]),
    ("Our model improves recall by 25%.", ["Our model = 7.0, Competitor = 0"], ["unknown"]),
    ("Ours outperforms all baselines.", ["Split B: ours 33.7 vs previous best 31.9"], ["ok"]),
    ("Our model outperforms the Competitor.", ["WER (lower is better): Our model = 6.1, Competitor = 8.4"], ["ok"]),
    ("Our model outperforms the Competitor.", ["Recall (higher is better): Our model = 55.0", "Runtime (lower is better): Competitor = 3.5"], ["unknown"]),
    ("Our model cuts latency by 7.5 points over the Competitor.", SLOW, ["ok"]),
    ("Our model cuts latency by 9.0 points over the Competitor.", SLOW, ["failed"]),
    ("Our model has the highest perplexity of the two.", ["Our model = 14.2, Competitor = 19.9"], ["failed"]),
    ("Crop corruption gives the second-smallest average drop.", ROWS, ["ok"]),
    ("Crop corruption gives the third-smallest average drop.", ROWS, ["failed"]),
    ("The average drop caused by noise corruption is 12.9 points.", ROWS, ["failed"]),
    ("A sentence without a number or a comparison.", ROWS, []),
    (None, None, []),
]


def test_claims(spark):
    rows = [(i, c, None if p is None else [(f"e0{k + 1}", t, None) for k, t in enumerate(p)]) for i, (c, p, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, claim string, pack array<struct<eid:string,text:string,normalized_numbers:array<struct<value:double,unit:string,context:string>>>>")
    got = {r["i"]: [x["status"] for x in r["checks"]] for r in numeric.check(df).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_a_later_duplicate_only_adds_its_direction(spark):
    pack = [("e1", "Our model = 6.5", [(6.5, "wer", "our model"), (2.0, None, None)])]
    df = spark.createDataFrame([("c", pack)], "claim string, pack array<struct<eid:string,text:string,normalized_numbers:array<struct<value:double,unit:string,context:string>>>>")
    m = numeric.check(df).first()["measures"]
    assert [(x["label"], x["value"], x["lower"]) for x in m] == [("Our model", 6.5, True), ("", 2.0, None)]


@pytest.mark.parametrize("protected", [True, False])
def test_override(spark, protected):
    rows = [("Our model outperforms all baselines.", [("e1", "Our model = 30.5, Competitor = 31.0", None)], "warranted", 0.5, [], ["e9"], protected)]
    df = spark.createDataFrame(rows, "claim string, pack array<struct<eid:string,text:string,normalized_numbers:array<struct<value:double,unit:string,context:string>>>>, verdict string, confidence double, issue_tags array<string>, predicted_eids array<string>, fallback boolean")
    from pyspark.sql import functions as F

    full = numeric.check(df.withColumn("allowed", F.array(F.lit("e1"))).withColumn("abstain", F.lit(True)).withColumn("rationale_short", F.lit("r")))
    got = numeric.override(full, protect="fallback").first()
    want = ("warranted", 0.5, [], ["e9"]) if protected else ("contradicted", 0.9, ["numerical_inconsistency"], ["e9", "e1"])
    assert (got["verdict"], got["confidence"], got["issue_tags"], got["predicted_eids"]) == want
