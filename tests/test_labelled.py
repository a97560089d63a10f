"""The probes read whole texts."""

from pyspark.sql import functions as F

import __spark_entry__
from veridict.plans.adapters import view

NAMES = ("a22_nb_counts", "a23_tokens", "m3_loo_nb")


def test_words_after_a_long_beginning_are_read(spark, tmp_path):
    rows = [(k, ("same words " * 30) + ("Telling" if k % 2 else "other")) for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    counts, tokens, bayes = (__spark_entry__.queries()[n](spark, str(tmp_path)).collect() for n in NAMES)
    assert {r["label"]: (r["documents"], r["tokens"], r["vocabulary"]) for r in counts} == {"warranted": (6, 366, 3), "insufficient": (6, 366, 3)}
    assert {r["label"]: r["token"] for r in tokens if r["place"] == 1} == {"warranted": "telling", "insufficient": "other"}
    assert all(r["label"] == r["predicted"] for r in bayes)


def test_the_view_has_whole_texts(spark):
    folder = "/root/testdata/sf0.001"
    own = view(spark, folder, "labelled").agg(F.sum(F.length("text"))).first()[0]
    want = spark.read.parquet(f"{folder}/labels.parquet").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").agg(F.sum(F.length(F.lower("text")))).first()[0]
    assert own == want
