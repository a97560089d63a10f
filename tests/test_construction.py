"""Splits, overlap, identifiers and gates: planted faults must fire, clean data must stay silent."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridict.operators import construction as con
from veridict.operators import ensemble, leakage, retrieval, validation

PACK = "split string, instance_id string, text string, pack array<struct<eid:string,text:string>>"


def corpus(spark):
    rows = [(f"p{p}_{i}", f"paper{p}", f"p{p}_{i - 1}" if i % 3 == 2 else None) for p in range(3) for i in range(6)]
    return spark.createDataFrame(rows, "instance_id string, paper_id string, seed_instance_id string")


def test_variants_stay_with_their_seed(spark):
    split = con.split_records(corpus(spark), "seed", {"public": 0.5, "hidden_val": 0.3, "hidden_test": 0.2})
    assert con.split_problems(split, ("public", "hidden_val", "hidden_test")).isEmpty()
    assert split.count() == 18


def test_too_few_groups_are_reported(spark):
    two = con.split_records(corpus(spark).where("paper_id <> 'paper2'"), "paper", {"a": 0.4, "b": 0.3, "c": 0.3})
    assert [r["problem"] for r in con.split_problems(two, ("a", "b", "c")).collect()] == ["split is empty"]


def test_overlap(spark):
    rows = [("a", "1", "Dropout before the encoder keeps recall stable.", []), ("b", "2", "Dropout before the encoder  keeps recall stabler.", []), ("b", "3", "Something else entirely.", [("e1", "x")]), ("b", "4", "something else entirely. ", [("e1", " X")]), ("b", "5", "Something else entirely.", [])]
    df = spark.createDataFrame(rows, PACK)
    assert [(r["left"], r["right"]) for r in con.similar(df).collect()] == [("1", "2")]
    assert [tuple(r) for r in con.duplicates(df).collect()] == [("b", "3", "4")]


def test_new_ids_and_rekey(spark):
    old = corpus(spark)
    ids = con.new_ids(old.select(F.col("instance_id").alias("old")), seed=1)
    new = con.rekey(old, ids)
    assert new.count() == 18 and new.select("instance_id").distinct().count() == 18
    assert new.where("seed_instance_id IS NOT NULL").count() == 6
    with pytest.raises(PySparkException, match="no new id"):
        con.rekey(old, ids.where("old <> 'p0_1'")).collect()


def test_repeated_keys_are_refused(spark):
    with pytest.raises(PySparkException, match="repeated key"):
        con.refuse_repeats(spark.createDataFrame([("a",), ("a",)], "instance_id string")).collect()


def test_forbidden_words(spark):
    documents = ['{"gold": 1}', '{"a": {"b": [{"stress": 0}]}}', '{"a": "split"}', '{"a": ["x", "venue"]}', '{"a": "the split of gold"}', '{"split": "gold"}']
    df = spark.createDataFrame(list(enumerate(documents)), "id int, j string").select("id", F.parse_json("j").alias("document"))
    got = {(r["id"], r["path"], r["hit"]) for r in validation.forbidden(df).collect()}
    assert got == {(0, "$.gold", "key"), (1, "$.a.b[0].stress", "key"), (2, "$.a", "value"), (3, "$.a[1]", "value"), (5, "$.split", "key")}


def test_bm25_ties_go_by_place(spark):
    units = spark.createDataFrame([("i", 1, "alpha beta"), ("i", 2, "alpha beta"), ("i", 3, "gamma")], "instance_id string, ordinal int, text string")
    got = retrieval.bm25(spark.createDataFrame([("i", "alpha alpha")], "instance_id string, text string"), units, 3).orderBy("place").collect()
    assert [r["ordinal"] for r in got] == [1, 2, 3] and got[0]["score"] == got[1]["score"] > got[2]["score"] == 0


@pytest.mark.parametrize("unanimous", [False, True])
def test_votes(spark, unanimous):
    rows = [("i", 0, "warranted", 0.9, False), ("i", 1, "warranted", 0.9, False), ("i", 2, "overclaimed", 0.9, False), ("j", 0, None, None, True), ("k", 0, "warranted", 0.95, True), ("l", 0, "insufficient", 0.95, True)]
    votes = ensemble.majority(spark.createDataFrame(rows, "instance_id string, ballot_no int, verdict string, confidence double, no_eids boolean"))
    got = {r["instance_id"]: r for r in ensemble.abstain(votes, threshold=0.0, unanimous=unanimous).collect()}
    assert got["i"]["confidence"] == pytest.approx(0.6) and got["i"]["abstain"] == unanimous
    assert got["j"]["fired"] == ["unparsable_json"] and got["k"]["fired"] == ["empty_evidence"] and not got["l"]["abstain"]


def test_dominance(spark):
    runs = spark.createDataFrame([("a", 0, 0.7, 0.1), ("a", 1, 0.8, 0.1), ("b", 0, 0.6, 0.1), ("b", 1, 0.7, 0.3)], "system string, pass int, accuracy double, sfwr double")
    got = {r["metric"]: (r["leader"], r["dominance"]) for r in ensemble.dominance(ensemble.repeat_medians(runs, ("accuracy", "sfwr"))).collect()}
    assert got == {"accuracy": ("a", "weak"), "sfwr": ("a", "weak")}


def test_probe_finds_a_planted_leak_and_no_other(spark):
    text = lambda k, leak: f"{'sure' if leak and k % 2 else 'plain'} word{k % 5}"
    for leak in (True, False):
        rows = spark.createDataFrame([(k, "ab"[k % 2], text(k, leak)) for k in range(24)], "instance_id int, label string, text string")
        r = leakage.permutation_test(rows, 40).first()
        assert (r["p"] < 0.05) == leak


def test_closed_form_equals_refitting(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(5)
    data = [(k, rng.choice("abc"), " ".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 6)))) for k in range(25)] + [(99, "d", "solo")]
    want = {}
    for i, _, text in data:
        rest = [(y, t.split()) for j, y, t in data if j != i]
        words = {w for _, t in rest for w in t}
        best = None
        for y in sorted({y for y, _ in rest}):
            own = [t for l, t in rest if l == y]
            c = Counter(w for t in own for w in t)
            s = math.log(len(own) / len(rest)) + sum(math.log((c[w] + 1) / (sum(c.values()) + len(words))) for w in text.split() if w in words)
            if best is None or s > best[0] + 1e-9:
                best = (s, y)
        want[i] = best[1]
    got = leakage.leave_one_out_bayes(spark.createDataFrame(data, "instance_id int, label string, text string"))
    assert {r["instance_id"]: r["predicted"] for r in got.collect()} == want


def test_student_half(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, j string").select("path", F.parse_json("j").alias("document"))
    clean = [("d/inputs.jsonl", '{"instance_id": "a", "evidence_pack": [{"eid": "e1"}]}'), ("d/inputs.jsonl", '{"instance_id": "b", "evidence_pack": []}')]
    assert validation.exit_code(validation.student_half_problems(make(clean))) == 0
    bad = [("d/x.json", '{"review": {"reviewer": "r"}}'), ("d/gold.jsonl", '{"instance_id": "a"}')]
    got = {r["problem"] for r in validation.student_half_problems(make(bad)).collect()}
    assert got == {"gold file", "private word at $.review", "private word at $.review.reviewer", "no inputs"}


def test_only_scored_runs_are_compared(spark):
    row = "SELECT {} AS scoreable, 0.5 AS accuracy, 0.5 AS macro_f1, 0.5 AS evidence_f1, 0.5 AS sfwr, 1.0 AS coverage, 0.5 AS augrc, 1 AS answered, 1 AS total"
    assert ensemble.comparison_row(spark.sql(row.format("true")), "s", 0).count() == 1
    with pytest.raises(PySparkException, match="cannot be scored"):
        ensemble.comparison_row(spark.sql(row.format("false")), "s", 0).collect()
