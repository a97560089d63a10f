"""A claim and pack that many rows share are checked once, and each row gets its own checks back."""

from veridict.operators import numeric


def test_each_distinct_pair_is_checked_once(spark):
    unit = "array<struct<eid:string,text:string,normalized_numbers:array<struct<value:double,unit:string,context:string>>>>"
    packs = [[("e1", "Method X = 25.0, Baseline = 20.0", None)], [("e1", "Method X = 15.0, Baseline = 20.0", [(None, None, None)])], [], None]
    claims = ["Method X outperforms the Baseline.", "Method X achieves 25.0 accuracy.", None]
    rows = [(k, claims[k % 3], packs[k % 4]) for k in range(240)]
    counted = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame(rows, f"id int, claim string, pack {unit}")
    own = numeric._checked
    numeric._checked = lambda rows, *a: own(rows.mapInArrow(lambda batches: ((counted.add(b.num_rows), b)[1] for b in batches), rows.schema), *a)
    try:
        got = numeric.check(table).select("id", "checks", "measures", "series").collect()
    finally:
        numeric._checked = own
    assert counted.value == 12
    want = own(table, "claim", "pack").select("id", "checks", "measures", "series").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 240
    by_id = {r["id"]: [c["status"] for c in r["checks"]] for r in got}
    assert by_id[0] == ["ok"] and by_id[9] == ["failed"] and by_id[11] == []
