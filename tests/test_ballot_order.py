"""Stated confidences are added up in the order of ballots, and rounded as SQL rounds."""

import random

from pyspark.sql import functions as F

from veridict.functions.text import rounded
from veridict.operators import ensemble


def test_the_mean_does_not_depend_on_the_order_of_rows(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(300):
        total, stated = 0.0, [1 - rng.randint(0, 10) / 100 for _ in range(rng.randint(3, 9))]
        for i, x in enumerate(stated):
            total += x
            rows.append((k, i, "warranted", x, False))
        want[k] = total / len(stated)
    want[300] = None
    rows += [(300, 0, "warranted", None, False), (300, 1, "contradicted", 0.5, True), (300, 2, "warranted", None, False)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        ballots = spark.createDataFrame(rows, "instance_id int, ballot_no int, verdict string, confidence double, no_eids boolean").repartition(7 + seed)
        assert {r["instance_id"]: r["mean_confidence"] for r in ensemble.majority(ballots).collect()} == want


def test_rounding_goes_by_the_product(spark):
    rows = spark.createDataFrame([(0.5045,), (0.5115,), (0.5125,), (0.25,), (None,)], "x double")
    assert [r[0] for r in rows.select(rounded(F.col("x"), 3)).collect()] == [0.504, 0.511, 0.513, 0.25, None]
