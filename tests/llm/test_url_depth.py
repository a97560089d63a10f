"""Branches that part below the fourth segment."""

import random

import pytest

from veridict.llm import url_filters


def test_a_bad_branch_beside_a_good_one_far_down(spark):
    for depth in (5,):
        above = "".join(f"/s{k}" for k in range(depth))
        rows = [(f"{above}/news/{i}", True) for i in range(30)] + [(f"{above}/pills/{i}", False) for i in range(30)] + [(f"{above}/pills/999", None), (f"{above}/news/999", None), ("", None), ("/", None)]
        got = {r["path"]: r["verdict"] for r in url_filters.template_verdicts(spark.createDataFrame([("h", p, g) for p, g in rows], "host string, path string, good boolean")).collect()}
        assert len(got) == len(rows)
        assert (got[f"{above}/pills/999"], got[f"{above}/news/999"]) == ("block", "allow")


def test_deep_urls_against_the_oracle(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(4)
    step = lambda: rng.choice(["es", "fr", "a", "b", "", f"x{rng.randint(0, 99)}", f"{rng.choice('uvwxyz')}{rng.choice('uvwxyz')}"])
    urls = [f"http://{rng.choice(['a.net', 'b.net', 'org'])}" + "".join(f"/{step()}" for _ in range(rng.randint(0, 9))) for _ in range(1500)] + [None, "nothing"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filters.OP1_SQL})").fetchall()
    got = [tuple(r) for r in url_filters.op1_url_filters(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len({v for *_, v in want}) == 2
