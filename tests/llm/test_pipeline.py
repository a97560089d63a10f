"""The pipeline's rows against its stages done by hand."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_quality
from tests.llm.test_simhash import brute as brute_near

tiktoken = pytest.importorskip("tiktoken")


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(500)]
    base = [" ".join(rng.choice(vocabulary, 80)) for _ in range(25)]
    rows = [(i, base[i], "ab"[i % 2]) for i in range(25)]
    rows += [(100 + i, base[i].replace(" ", "\n", 1), "a") for i in range(5)]  # exact copies but for a blank
    for i in range(12):  # near copies
        words = base[i].split()
        words[rng.integers(80)] = "changed"
        rows.append((200 + i, " ".join(words), "b"))
    rows += [(300, None, None), (301, "short", "a"), (302, "| x " * 40, "b")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))

    kept = [r for r in rows if brute_quality(r[1])[-1]]
    seen, exact = set(), []
    for r in sorted(kept):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1])
        if key not in seen:
            seen.add(key)
            exact.append(r)
    first = {i: c for i, _, c in brute_near([(i, t) for i, t, _ in exact])}
    near = {i: (t, s) for i, t, s in exact if first[i] == i}
    from veridict.llm import mixing
    from veridict.llm.training_order import _tokenizer

    df = spark.createDataFrame([(i, t, s) for i, (t, s) in near.items()], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(df, ["doc_id"]).collect()}
    want = []
    for i, (t, _) in near.items():
        ids = _tokenizer(None).encode_ordinary(t)
        row = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        want += [row] * copies[i]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(near) < len(exact) < len(kept) < len(rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
