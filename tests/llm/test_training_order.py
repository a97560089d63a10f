import numpy as np
import pytest

from veridict.llm import bpe
from veridict.llm import training_order as order


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 65537])
def test_permutation_and_its_inverse(n):
    p = order.Permutation(n, 42)
    slots = p.slots(np.arange(n))
    assert sorted(slots) == list(range(n))
    assert (p.numbers(slots) == np.arange(n)).all()
    assert n < 200 or (order.Permutation(n, 43).slots(np.arange(n)) != slots).any()


def test_shards_hold_every_sequence_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "höhle", "x9"], rng.integers(1, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id"), rows[5], rows[5]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(5)
    got = [r.asDict() for r in order.materialise(df, str(tmp_path), tokens=8, per_shard=50).collect()]
    encode = order._tokenizer(None).encode_ordinary
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert all(r["shard"] == r["slot"] // 50 and r["byte_offset"] == r["slot"] % 50 * 16 for r in got)
    stored = order.read_slots(str(tmp_path), 0, len(got))
    assert stored.shape == (len(got), 8) and (order.read_slots(str(tmp_path), 37, 61) == stored[37:98]).all()
    want = sorted((str(i), k // 8, tuple(t[k : k + 8])) for i, text in rows for t in [encode(text or "")] for k in range(0, len(t), 8))
    have = sorted((str(r["doc_id"]), r["part"], tuple(stored[r["slot"], : r["n_tokens"]].tolist())) for r in got)
    assert have == want
    assert all((stored[r["slot"], r["n_tokens"] :] == order.filling()).all() for r in got)


def test_empty_table(spark, tmp_path):
    assert order.materialise(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path)).count() == 0


def test_ids_are_those_of_the_vocabularys_pattern(monkeypatch):
    """The encoder of op4, which cuts by the pattern itself, gives the same ids; so do texts cut at runs of blanks."""
    monkeypatch.setattr(order, "LONG_RUN", 2)
    rng = np.random.default_rng(3)
    some = [*"ab'sdtmlvreé9 \n\t\r\x1c\x85\xa0\u2003\u3000\0_!.“𝟘中\u0301", "'ll", "'ve", "'re", "  ", "\n\n", order.NEVER, " the", "höhle"]
    for n in rng.integers(0, 40, 3000):
        text = "".join(rng.choice(some, n))
        want = np.frombuffer(bpe.codec().encode(text), "<u4")
        assert order.token_ids(text).tolist() == want.tolist(), repr(text)
        cut = np.concatenate([order.token_ids(part) for part in order.without_long_blanks(text)])
        assert cut.tolist() == want.tolist(), repr(text)


def test_very_long_runs_of_blanks(spark, tmp_path):
    """Of a million blanks the pattern's backtracking takes more stack than it has."""
    run = 1_200_000
    texts = ["a" + " " * run + "cat " + "\n" * run + " b\n", " " * run, "x" + "\n" * run, "the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.asDict() for r in order.materialise(df, str(tmp_path)).collect()]
    stored = order.read_slots(str(tmp_path), 0, len(got))
    for i, text in enumerate(texts):
        parts = sorted((r["part"], r["slot"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        have = np.concatenate([stored[slot, :n] for _, slot, n in parts])
        assert (have == np.frombuffer(bpe.codec().encode(text), "<u4")).all()
