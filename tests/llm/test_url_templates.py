"""Merging of branches by what their subtrees look like, and verdicts of branches without labels."""

from veridict.llm import url_filters


def verdicts(spark, rows):
    frame = spark.createDataFrame(rows, "host string, path string, good boolean")
    return {(r["host"], r["path"]): (r["template"], r["verdict"]) for r in url_filters.template_verdicts(frame).collect()}


def test_branches_without_labels_go_by_those_like_them(spark):
    like = lambda host, name, n, good: [(host, f"/{name}/{i}", good) for i in range(n)]
    other = [("bad", f"/shop/item/{chr(97 + i % 26)}x/{i}/reviews", None) for i in range(40)]
    rows = like("bad", "es", 30, False) + like("bad", "fr", 20, False) + like("bad", "de", 25, None) + other
    rows += like("good", "es", 30, True) + like("good", "de", 25, None)
    rows += like("mixed", "es", 30, False) + like("mixed", "en", 30, True) + like("mixed", "de", 25, None)
    got = verdicts(spark, rows)
    assert {got["bad", f"/de/{i}"][1] for i in range(25)} == {"block"}  # merged with es and fr, all whose labels are bad
    assert got["bad", "/de/1"][0] == got["bad", "/es/1"][0] == got["bad", "/fr/1"][0]
    assert {got[h, p] for h, p, _ in other} == {(got[other[0][:2]][0], "allow")} and got[other[0][:2]][0] != got["bad", "/de/1"][0]
    assert {got["good", f"/de/{i}"][1] for i in range(25)} == {"allow"}
    # labels of a branch's own outweigh those of the pool
    assert [got["mixed", f"/{x}/3"][1] for x in ("es", "en", "de")] == ["block", "allow", "allow"]


def test_the_tree_decides_on_the_tables(spark):
    got = url_filters.op1_url_filters(spark, "/root/testdata/sf0.01").where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_repeated_rows_null_and_very_long_urls(spark):
    long = "http://long.net/" + "x" * 300_000 + "/1?q=" + "y" * 300_000
    deep = "http://deep.net" + "/a" * 3000
    rows = [(1, long), (1, long), (2, None), (2, None), (3, deep), (4, "http://h.net/es/1"), (4, "http://h.net/es/1"), (None, "http://h.net/es/1")]
    got = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in got) == [(0, "block"), (1, "allow"), (1, "allow"), (2, "allow"), (2, "allow"), (3, "allow"), (4, "block"), (4, "block")]
    assert {len(r["path"]) for r in got if r["page_id"] == 1} == {300_003}
