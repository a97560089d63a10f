"""Registry of the subpackage's queries and of the SQL that checks them."""

from __future__ import annotations

from veridict.llm import bpe, exact_dedup, mixing, quality_classifier, quality_rules, sharding, simhash, substring_dedup, training_order, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_simhash": simhash.op9_simhash,
    "op10_training_order": training_order.op10_training_order,
}

ORACLES = {
    "op1_url_filters": url_filters.OP1_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
