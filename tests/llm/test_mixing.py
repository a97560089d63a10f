"""The draw of copies, recomputed row by row in plain Python from the same hash."""

import math
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.test_operators import brute_targets, docs
from veridict.llm import mixing

xxhash = pytest.importorskip("xxhash")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spark_hash(*values):
    """Spark's xxhash64: each value's XXH64 seeds the next; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def unit(h):
    return ((h >> 11) + 0.5) / (1 << 53)


def size_class(n):
    bits = max(1, n.bit_length())
    return bits * 128 + (n >> max(0, bits - 7))


def brute_copies(rows, rows_per_bucket):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    of_source = Counter()
    for (_, _, s), n in zip(rows, sizes):
        of_source[s] += n
    targets = brute_targets(dict(of_source))
    classes = defaultdict(list)
    for k, ((i, t, s), n) in enumerate(zip(rows, sizes)):
        classes[s, size_class(n)].append((signed(spark_hash(i, t, "mix")), k))
    out = [0] * len(rows)
    for source in of_source:
        rate = targets[source] / of_source[source] if of_source[source] else 0.0
        at, fraction, offset = 0, rate - math.floor(rate), unit(spark_hash(source, "offset"))
        for _, own in sorted((c, x) for (s, c), x in classes.items() if s == source):
            buckets = -(-len(own) // rows_per_bucket)
            for b in range(buckets):
                inside = sorted(x for x in own if x[0] % buckets == b)
                wanted = math.floor((at + len(inside)) * fraction + offset) - math.floor(at * fraction + offset)
                times, seen, taken = Counter(h for h, _ in inside), 0, set()
                for h in sorted(times):
                    if seen + times[h] - times[h] // 2 <= wanted:
                        taken.add(h)
                    seen += times[h]
                for h, k in inside:
                    out[k] = math.floor(rate) + (h in taken)
                at += len(inside)
    return out, targets, sizes


@pytest.mark.parametrize("rows_per_bucket", [20_000, 7])
def test_copies_against_brute_force(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", rows_per_bucket)
    rows = [(i, "w " * (1 + i * 7 % 300), "ab"[i % 3 > 0]) for i in range(700)] + [(1000 + i, "x y", "c") for i in range(60)]
    rows += [(2000, None, "empty"), (2001, "", None), (None, "no id", "a"), (None, "no id either", None), (5, "long " * 30_000, "b")]
    rows += [(3000, "again and again", "c")] * 9
    want, _, sizes = brute_copies(rows, rows_per_bucket)
    got = mixing.mix_plan(docs(spark, rows), ["doc_id", "text", "source"]).collect()
    assert Counter((r["doc_id"], r["text"], r["source"], r["size"], r["copies"]) for r in got) == Counter((*r, n, c) for r, n, c in zip(rows, sizes, want))
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    assert Counter(map(tuple, mixed.select("doc_id", "text", "source").collect())) == sum((Counter({r: c}) for r, c in zip(rows, want)), Counter())


def test_every_source_meets_its_target_within_a_document(spark):
    got = mixing.op8_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert len(target) > 3
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_each_chance_is_the_fraction(spark):
    """Over many sources that differ in their offsets, a document is taken once more as often as the fraction says."""
    rows = [(i, "w " * (1 + i % 9), f"s{i % 400:03d}") for i in range(12_000)]
    got = mixing.mix_plan(docs(spark, rows), ["doc_id", "source"]).collect()
    expected = sum(r["target"] / r["source_size"] for r in got)
    assert abs(sum(r["copies"] for r in got) - expected) < 200
    for size in (1, 5, 9):
        own = [r for r in got if r["size"] == size]
        assert sum(r["copies"] for r in own) == pytest.approx(sum(r["target"] / r["source_size"] for r in own), rel=0.06)
