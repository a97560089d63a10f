"""The query of the features returns all that the operator computes."""

import __spark_entry__


def test_all_features_are_returned(spark):
    got = __spark_entry__.queries()["p19_features"](spark, "/root/testdata/sf0.001")
    kinds = {r[0] for r in got.selectExpr("split(name, '=')[0]").distinct().collect()}
    assert kinds == {"claim_length_chars", "claim_length_words", "evidence_count", "evidence_len_mean", "evidence_len_max", "evidence_len_min", "evidence_len_total", "allowed_eids_count", "claim_type", "scope", "paper_id", "id_length", "id_digits", "modality", "source_kind", "first_source_kind", "last_source_kind"}
