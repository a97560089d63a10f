"""The permutation test against leave-one-out Bayes on shuffled labels, and as it is registered."""

import random
import statistics

import pytest

import __spark_entry__
from veridict.operators import leakage


@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_equals_one_model_a_permutation(spark, monkeypatch, cells):
    monkeypatch.setattr(leakage, "CELLS", cells)
    rng = random.Random(5)
    data = [(k, rng.choice("abc"), " ".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 6)))) for k in range(25)] + [(99, "d", "solo u"), (100, "a", None), (101, "a", "alone")]
    shuffle, labels, accuracy = random.Random(7), [y for _, y, _ in data], []
    for p in range(6):
        if p:
            shuffle.shuffle(labels)
        rows = spark.createDataFrame([(i, y, t) for (i, _, t), y in zip(data, labels)], "instance_id int, label string, text string")
        guessed = leakage.leave_one_out_bayes(rows).collect()
        accuracy.append(sum(r["label"] == r["predicted"] for r in guessed) / len(data))
    rows = spark.createDataFrame(data, "instance_id int, label string, text string")
    r = leakage.permutation_test(rows, 5).first()
    want = (accuracy[0], (1 + sum(a >= accuracy[0] for a in accuracy[1:])) / 6, statistics.median(accuracy[1:]), max(accuracy[1:]))
    assert (r["observed"], r["p"], r["median"], r["most"]) == pytest.approx(want)


def test_the_query_makes_500_permutations(spark, monkeypatch):
    made = []
    own = leakage.permuted
    monkeypatch.setattr(leakage, "permuted", lambda *a: made.append(own(*a)) or made[-1])
    r = __spark_entry__.queries()["m2_permutation"](spark, "/root/testdata/sf0.001").first()
    assert [len(x) for x in made] == [501] and r["p"] * 501 == pytest.approx(round(r["p"] * 501))


def test_a_pass_over_the_texts_makes_many_permutations():
    assert leakage.at_once(700_000, 4) >= 10 and leakage.at_once(1 << 40, 4) == 1
