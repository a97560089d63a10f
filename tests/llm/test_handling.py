"""Very long texts, repeated rows, empty tables and clashing columns where the other tests have none; sharding by hand."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tests.llm.test_mixing import spark_hash, unit
from tests.llm.test_operators import docs
from veridict.llm import bpe, exact_dedup, sharding, simhash, training_order


def brute_shard(doc_id, weights):
    """The smallest of -log(u) / weight over the shards. Spark hashes the shard's number as an int, by four bytes."""
    h, scores = spark_hash(doc_id), []
    for s, w in enumerate(weights):
        scores.append((-math.log(unit(xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h))) / w, s))
    return min(scores)[1]


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 2.0, 0.5], [3.0]])
def test_shards_against_plain_rendezvous(spark, monkeypatch, weights):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 30)
    rows = [(i * 7919 - 5000, f"text {i}", "s") for i in range(600)] + [(None, "n", "s")] * 3 + [(4, "x" * 2_000_000, "s")] + [(5, "again", "s")] * 200
    got = sharding.shard_rows(docs(spark, rows), len(weights), weights).collect()
    assert Counter((r["doc_id"], r["shard"], r["grown_shard"]) for r in got) == Counter((i, brute_shard(i, weights), brute_shard(i, [*weights, 1.0])) for i, _, _ in rows)
    assert max(r["size"] for r in got) == 2_000_008
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))


def test_of_repeated_rows_the_first_by_a_fixed_order_stays(spark):
    rows = [(1, "same text", f"source{k}") for k in (3, 1, 2)] + [(2, "same  text", "x"), (None, "lonely", "b"), (None, "lonely", "a"), (3, None, "y")]
    for parts in (1, 5):
        left = exact_dedup.drop_copies(docs(spark, rows).repartition(parts))
        assert sorted(((r["doc_id"], r["source"]) for r in left.collect()), key=str) == [(1, "source1"), (3, "y"), (None, "a")]


def test_very_long_texts(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choice(words, 200_000))
    near = long.replace("w17 ", "w18 ", 3)
    df = docs(spark, [(1, long, "s"), (2, near, "s"), (3, "short and other", "s")])
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    index = training_order.materialise(df, str(tmp_path), per_shard=1000).collect()
    ids = training_order._tokenizer(None).encode_ordinary(long)
    own = sorted((r["part"], r["slot"], r["n_tokens"]) for r in index if r["doc_id"] == 1)
    assert sum(n for *_, n in own) == len(ids)
    stored = training_order.read_slots(str(tmp_path), 0, len(index))
    assert np.concatenate([stored[slot][:n] for _, slot, n in own]).tolist() == ids


def test_vocabularies_of_any_size(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path(bpe.VOCABULARY)
    small = tmp_path / "bytes.tiktoken"
    small.write_text("\n".join(line for line in open(path).read().splitlines() if int(line.split()[1]) < 256))
    index = training_order.materialise(docs(spark, [(1, "abc", "s")]), str(tmp_path / "a"), tokens=8, path=str(small)).first()
    assert index["n_tokens"] == 3 and training_order.read_slots(str(tmp_path / "a"), 0, 1)[0, 3:].tolist() == [256] * 5
    large = tmp_path / "large.tiktoken"
    lines = small.read_text().splitlines()
    large.write_text("\n".join([*lines[:-1], lines[-1].split()[0] + " 70000"]))
    training_order.materialise(docs(spark, [(1, "abc", "s")]), str(tmp_path / "b"), tokens=8, path=str(large))
    assert training_order.read_slots(str(tmp_path / "b"), 0, 1)[0, 3:].tolist() == [70001] * 5


def test_encoding_empty_tables_and_repeats(spark):
    assert bpe.digests(docs(spark, [])).count() == 0
    got = bpe.digests(docs(spark, [(1, "twice", "s"), (1, "twice", "s"), (None, "no id", None)])).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 2, None: 1} and len({r["ids_sha256"] for r in got}) == 2


def write(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, w string, t string, kept boolean, size long").write.parquet(f"{folder}/documents.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_with_nulls_clashes_and_a_very_long_text(spark, tmp_path):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice([f"word{i}" for i in range(900)], n))
    row = lambda i, t, s: (i, t, None, s, None, "r", "w", "t", True, 5)
    rows = [row(i, text(60), None if i % 3 else "a") for i in range(30)] + [row(100, text(50_000), "a"), row(None, text(40), None), row(101, None, None), row(102, "", "a")]
    rows += [rows[0], rows[0]]
    got = write(spark, tmp_path / "full", rows)
    kept = {r["doc_id"] for r in got}
    assert kept <= {*range(30), 100, None} and len(kept) > 15
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): i for i, t, *_ in rows}
    assert all(texts[r["decoded_sha256"]] == r["doc_id"] for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert write(spark, tmp_path, []) == []
