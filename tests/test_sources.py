import json

import pytest
from pyspark.errors import PySparkException

from veridict.sources import jsonl, models


def test_lines_have_numbers_and_broken_ones_fail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\xef\xbb\xbf{"x": 1}\n\n  \n{"x": "\xd1\x8f"}\r\n')
    rows = jsonl.read_lines(spark, str(tmp_path / "a.jsonl")).selectExpr("line", "to_json(document) AS j").collect()
    assert [(r["line"], json.loads(r["j"])) for r in rows] == [(1, {"x": 1}), (4, {"x": "я"})]
    for broken in ("[1]", "{", '"s"'):
        (tmp_path / "b.jsonl").write_text('{"x": 1}\n' + broken)
        with pytest.raises(PySparkException, match="b.jsonl:2"):
            jsonl.read_lines(spark, str(tmp_path / "b.jsonl")).collect()


def test_structured_scan_takes_json_and_refuses_broken(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text('{"a": [1]}')
    (tmp_path / "d/b.ndjson").write_text('{"b": 1}\n{"b": 2}\n')
    (tmp_path / "d/c.txt").write_text("not read")
    assert jsonl.read_structured(spark, str(tmp_path)).count() == 3
    (tmp_path / "d/e.json").write_text("{")
    with pytest.raises(PySparkException):
        jsonl.read_structured(spark, str(tmp_path)).collect()


def test_the_last_file_wins(spark, tmp_path):
    (tmp_path / "1.jsonl").write_text('{"instance_id": "i", "stress": {"is_stress_case": true, "stress_type": "a"}}\n{"instance_id": "j"}')
    (tmp_path / "2.jsonl").write_text('{"instance_id": "i", "stress": {"is_stress_case": true, "stress_type": "b"}}')
    got = jsonl.stress_metadata(spark, [str(tmp_path / "1.jsonl"), str(tmp_path / "2.jsonl")]).collect()
    assert sorted(tuple(r) for r in got) == [("i", True, "b", None), ("j", False, None, None)]


def test_sinks_keep_sides_apart(spark, tmp_path):
    rows = spark.createDataFrame([("a", "public"), ("b", "hidden")], "instance_id string, split string")
    jsonl.write_two_sided(rows, rows, str(tmp_path / "students"), str(tmp_path / "staff"))
    count = lambda p: spark.read.json(str(tmp_path / p)).count()
    assert (count("students/inputs"), count("students/gold"), count("staff/gold")) == (2, 1, 2)
    assert jsonl.replace_all("a b a", {"a": "c"}) == ("c b c", 2)


def test_models(spark, tmp_path, monkeypatch):
    prompts = spark.createDataFrame([("i", "hello")], "instance_id string, prompt string")
    assert models.ask(prompts, str.upper).first()["reply"] == "HELLO"
    assert models.recorded(prompts, spark.createDataFrame([], "instance_id string, reply string")).first()["reply"] is None
    (tmp_path / ".env").write_text("A_NAME=new\nB_NAME='two'\n# C=3\n")
    monkeypatch.setenv("A_NAME", "old")
    monkeypatch.delenv("B_NAME", raising=False)
    models.read_env(str(tmp_path / ".env"))
    import os

    assert (os.environ["A_NAME"], os.environ.pop("B_NAME")) == ("old", "two")


def test_lines_of_several_splits_are_numbered(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        (tmp_path / "a.jsonl").write_text("".join(f'{{"x": {k}}}\n' + "\t\n\u2003\n" * (k % 3) for k in range(400)), encoding="utf-8")
        rows = jsonl.read_lines(spark, str(tmp_path)).selectExpr("line", "variant_get(document, '$.x', 'int') AS x").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    line, want = 1, []
    for k in range(400):
        want.append((line, k))
        line += 1 + 2 * (k % 3)
    assert sorted(map(tuple, rows)) == want


def test_splits_refuse_broken_lines_and_name_records_without_an_id(spark, tmp_path):
    (tmp_path / "a").mkdir()
    good = '{"instance_id": "i", "claim": {"text": "c"}, "evidence_pack": [{"eid": "e1", "text": "t"}]}'
    (tmp_path / "a/x.jsonl").write_text(good + "\n\n" + good.replace('"instance_id": "i", ', "") + '\n[1]\n{"gold": 1}\n')
    (tmp_path / "a/internal_annotation.jsonl").write_text("{")
    got = jsonl.collect_splits(spark, {"s": str(tmp_path / "a")}).collect()
    assert sorted((r["split"], r["instance_id"], r["text"], r["pack"][0]["eid"]) for r in got) == [("s", "<x.jsonl:3>", "c", "e1"), ("s", "i", "c", "e1")]
    (tmp_path / "a/y.jsonl").write_text("{\n")
    with pytest.raises(PySparkException, match="y.jsonl:1"):
        jsonl.collect_splits(spark, {"s": str(tmp_path / "a")}).collect()


def test_files_of_one_name_go_by_the_order_of_their_paths(spark, tmp_path):
    for folder, kind in (("b", "first"), ("a", "second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.jsonl").write_text(f'{{"instance_id": "i", "stress": {{"is_stress_case": true, "stress_type": "{kind}"}}}}')
    assert jsonl.stress_metadata(spark, [str(tmp_path / "b/x.jsonl"), str(tmp_path / "a/x.jsonl")]).first()["stress_type"] == "second"


def test_a_lenient_scan_keeps_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken\n\n')
    assert sorted((r["text"], r["j"]) for r in jsonl.read_lenient(spark, str(tmp_path / "a.jsonl")).selectExpr("text", "to_json(document) AS j").collect()) == [("broken", None), ('{"x": 1}', '{"x":1}')]
