import hashlib
from collections import Counter

import numpy as np
import pytest

from veridict.llm import substring_dedup, suffix_array


def brute(rows, length):
    seen = {}
    for i, (_, text) in enumerate(rows):
        data = (text or "").encode()
        for at in range(len(data) - length + 1):
            seen.setdefault(data[at : at + length], []).append((i, at))
    gone = [bytearray(len((text or "").encode())) for _, text in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                gone[i][at : at + length] = b"\1" * length
    out = []
    for (doc_id, text), mask in zip(rows, gone):
        data = (text or "").encode()
        kept = bytes(b for b, m in zip(data, mask) if not m)
        spans = sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((doc_id, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, many=1):
    rng = np.random.default_rng(seed)
    noise = lambda n: "".join(rng.choice(list("abcdefghé\n "), n))
    passage, common = noise(150), noise(60)
    rows = [(1, None), (2, ""), (None, noise(70)), (3, "a" * 300), (4, "ab" * 120), (5, noise(39)), (6, noise(500))]
    for i in range(40 * many):
        a, b = sorted(rng.integers(0, 150, 2))
        rows.append((100 + i, noise(rng.integers(0, 90)) + (passage[a:b] if i % 3 else common) + noise(rng.integers(0, 90))))
    rows += [(200 + i, rows[6][1]) for i in range(4)]  # copies
    rows += [(300, rows[6][1][100:400]), (301, rows[6][1][:60] + rows[6][1][:60]), (302, "z" + rows[6][1][37:99])]
    rows += [rows[-1], rows[-1], (None, rows[2][1])]  # repeated rows
    return rows


@pytest.mark.parametrize("shard_bytes", [2 << 20, 3000, 200])
def test_against_brute_force(spark, shard_bytes):
    rows = corpus(shard_bytes)
    df = spark.createDataFrame([(*r, "v", 1) for r in rows], "doc_id long, text string, v string, place int")
    got = substring_dedup.substring_dedup(df, length=40, gram=8, shard_bytes=shard_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 40)


def brute_digests(texts, length):
    """Removed bytes by counting digests of all windows."""
    window = lambda data, at: hashlib.blake2b(data[at : at + length], digest_size=16).digest()
    times = Counter(window(d, at) for d in texts for at in range(len(d) - length + 1))
    out = []
    for d in texts:
        gone = np.zeros(len(d), bool)
        for at in range(len(d) - length + 1):
            if times[window(d, at)] > 1:
                gone[at : at + length] = True
        out.append((int(gone.sum()), int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_whole_table_at_the_production_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute_digests([(r["text"] or "").encode() for r in rows], substring_dedup.LENGTH)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.op2_substring_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want)}
    assert sum(w[0] for w in want) > 100_000


def test_a_very_long_text(spark):
    """Longer than the windows that are looked at together, with a passage that stands across their border."""
    rng = np.random.default_rng(8)
    noise = rng.integers(97, 123, substring_dedup.WINDOWS_AT_ONCE + 50_000).astype(np.uint8).tobytes().decode()
    at = substring_dedup.WINDOWS_AT_ONCE - 150
    rows = [(1, noise), (2, "x" * 20 + noise[at : at + 300] + "y"), (3, noise[77:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(df, length=40, gram=8).collect()}
    assert got == dict(zip((1, 2, 3), brute_digests([t.encode() for _, t in rows], 40)))
    assert [got[i][0] for i in (1, 2, 3)] == [423, 300, 123]


def test_empty_table(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(9)
    strings = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(1, 60, 30)]
    for depth in (3, 8, 13, 20):
        owner, offset, classes = suffix_array.repeated_classes(strings, depth)
        found = {}
        for o, a, c in zip(owner, offset, classes):
            found.setdefault(int(c), set()).add((int(o), int(a)))
        want = {}
        for i, s in enumerate(strings):
            for a in range(len(s) - depth + 1):
                want.setdefault(s[a : a + depth], set()).add((i, a))
        assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_kasai_equals_comparison():
    rng = np.random.default_rng(10)
    data = rng.integers(97, 100, 400).astype(np.uint8)
    text = data.tobytes()
    order = sorted(range(400), key=lambda i: text[i:])
    left = 400 - np.arange(400)
    got = suffix_array.common_prefixes(suffix_array.words_at(data), left, np.array(order[1:]), np.array(order[:-1]))
    for g, a, b in zip(got, order, order[1:]):
        n = 0
        while max(a, b) + n < 400 and text[a + n] == text[b + n]:
            n += 1
        assert g == n
