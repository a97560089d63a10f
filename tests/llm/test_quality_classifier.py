"""Importance resampling against a plain recomputation, and what it keeps of the labelled documents."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_mixing import spark_hash, unit
from tests.llm.test_operators import docs
from veridict.llm import quality_classifier as qc


def brute(rows, labels, share=None):
    judged = {}
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            judged[i] = judged.get(i, True) and quality == 1 and not toxic
    share = sum(judged.values()) / len(judged) if share is None else share
    found = [Counter(qc.buckets((t or "").encode()).tolist()) for _, t, _ in rows]
    own = [judged.get(i, False) for i, _, _ in rows]
    good, every = Counter(), Counter()
    for f, g in zip(found, own):
        every.update(f)
        good.update(f if g else {})
    side = lambda b: b >= qc.WORDS
    totals = {s: (sum(n for b, n in good.items() if side(b) == s), sum(n for b, n in every.items() if side(b) == s)) for s in (False, True)}
    keys = []
    for (i, t, _), f, g in zip(rows, found, own):
        weight = 0.0
        for b, n in f.items():
            prior, (of_good, of_all) = (qc.PAIR_PRIOR if side(b) else qc.WORD_PRIOR), totals[side(b)]
            weight += n * (math.log(good[b] - n * g + prior) - math.log(every[b] * of_good / max(of_all, 1) + prior))
        keys.append((i, weight, weight - math.log(-math.log(unit(spark_hash(i, t, "gumbel"))))))
    k = round(len(rows) * share)
    least = sorted((key for *_, key in keys), reverse=True)[k - 1] if k else math.inf
    return sorted(((i, w, key) for i, w, key in keys if key >= least), key=str)


def corpus():
    rng = random.Random(3)
    make = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    clean, junk = [f"Word{i}" for i in range(60)], [f"spam{i}" for i in range(20)]
    rows = [(i, make(clean if i % 4 else junk + clean[:5], rng.randint(0, 40)), "s") for i in range(300)]
    rows += [(900, None, "s"), (901, "", "s"), (None, make(clean, 20), "s"), (902, make(clean, 60_000), "s"), (903, make(junk, 30_000), "s")]
    rows += [rows[7]] * 5 + [rows[8], (8, "another text of the same id", "s")]
    labels = [(i, int(i % 4 > 0), int(i % 15 == 1)) for i in range(0, 300, 2)] + [(5000, 1, 0), (1, None, None), (None, 1, 0), (2, 0, 0), (902, 1, None)]
    return rows, labels


@pytest.mark.parametrize("share", [None, 0.3])
def test_against_brute_force(spark, share):
    rows, labels = corpus()
    got = sorted(((r["doc_id"], r["log_weight"], r["gumbel_key"]) for r in qc.resample(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), share).collect()), key=str)
    want = brute(rows, labels, share)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in want], rtol=1e-9, atol=1e-9)


def test_rows_that_tie_at_the_threshold_stay(spark):
    rows = [(1, "a b c", "s")] * 40 + [(i, f"x{i} y{i}", "s") for i in range(2, 12)]
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    kept = Counter(r["doc_id"] for r in qc.resample(docs(spark, rows), labels, 0.5).collect())
    assert kept[1] in (0, 40) and sum(kept.values()) >= 25


def test_what_is_kept_of_the_labelled(spark):
    """Weights of labelled good documents are made without themselves, so these figures hold for others too."""
    folder = "/root/testdata/sf0.1"
    kept = qc.op5_quality_classifier(spark, folder).select("doc_id", "kept")
    labels = spark.read.parquet(f"{folder}/labels.parquet").join(kept, "doc_id", "left")
    share = {(r["quality"], r["toxic"]): r["kept"] for r in labels.selectExpr("quality", "toxic", "CAST(coalesce(kept, false) AS INT) AS k").groupBy("quality", "toxic").agg({"k": "avg"}).withColumnRenamed("avg(k)", "kept").collect()}
    assert share[1, 0] > 0.93 and share[0, 0] < 0.05 and share[1, 1] < 0.35
