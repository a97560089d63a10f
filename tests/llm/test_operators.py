"""The dealt operators on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import re
from collections import Counter

import pytest

from veridict.llm import exact_dedup, golomb, mixing, quality_classifier, quality_rules, sharding, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, source string, size long, n long, w string, t string, kept boolean"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "w", "t", True) for i, t, s in rows], CLASH)


ROWS = [(1, "a b  c", "x"), (2, "a b c", "y"), (3, "a\tb\nc", "x"), (4, None, None), (5, "", "z"), (6, " ", "z"), (None, "d", "x"), (7, "d", "y"), (8, "é" * 70_000, "x"), (9, "unique text", None), (9, "unique text", None)]


def test_golomb_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for numbers in ([], [0], [5, 5, 5], [2**64 - 1], [0, 1, 2**63, 2**64 - 1], rng.integers(0, 2**63, 5000), rng.integers(0, 300, 500)):
        x = np.sort(np.array(numbers, np.uint64))
        assert (golomb.decode(golomb.encode(x)) == x).all()


def test_exact_groups(spark):
    got = sorted(map(tuple, exact_dedup.exact_groups(docs(spark, ROWS)).collect()), key=str)
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = []
    for i, t, _ in ROWS:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        keep = min((x for x in groups[key] if x is not None), default=None)
        want.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    left = exact_dedup.drop_copies(docs(spark, ROWS))
    assert left.columns == docs(spark, ROWS).columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 4, 6, 7, 8, 9]


def test_exact_groups_with_many_owners_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PER_OWNER", 3)
    monkeypatch.setattr(exact_dedup, "CHUNK", 4)
    rows = [(i, f"text {i % 40 if i > 30 else 0}", "s") for i in range(200)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs(spark, rows).repartition(7)).collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t, []).append(i)
    assert got == {i: (min(groups[t]), len(groups[t])) for i, t, _ in rows}


def test_shards(spark):
    rows = ROWS + [(5, "", "z")] * 300
    got = sharding.shard_rows(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    per = Counter(r["shard"] for r in got)
    assert set(per) <= set(range(4))
    for s, n in per.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    assert {r["doc_id"]: r["size"] for r in got}[8] == 140_008 and {r["doc_id"]: r["text_crc32"] for r in got}[4] == 0
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})


def test_added_shards_only_take(spark):
    many = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    four, five = ({r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_rows(many, n).collect()} for n in (4, 5))
    assert all(four[i][1] == five[i][0] for i in four)
    assert max(Counter(s for s, _ in four.values()).values()) < 1150
    weighted = Counter(r["shard"] for r in sharding.shard_rows(many, weights=[1.0, 3.0]).collect())
    assert 2.6 < weighted[1] / weighted[0] < 3.5


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in share.items() if t > most * sizes[s]}
        if not over:
            return {**{s: float(most * sizes[s]) for s in full}, **share}
        full |= over


@pytest.mark.parametrize("case", range(5))
def test_mixture(spark, case):
    sources = ["a", "b", "c", None, "Z", "é"][: case + 2]
    rows = [(i, "w " * (1 + (i * 7) % 30 if k != 1 else 1), s) for k, s in enumerate(sources) for i in range(k * 1000, k * 1000 + 40 * (k + 1))] + [(None, None, "empty")]
    got = mixing.mix_plan(docs(spark, rows), ["doc_id", "source"]).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes) | ({"empty": 0}))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate + 1e-9) <= r["copies"] <= int(rate + 1 - 1e-9) + 1 and r["copies"] <= 3
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns and mixed.count() == sum(r["copies"] for r in got)


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for k in range(5)}
    chars, symbols, dup = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    odd = not 2 <= chars / max(1, len(w)) <= 25
    good = not (failed or symbols > 0.1 * len(w) or dup > 0.3 * len(lines) or odd or sum("A" <= c <= "Z" for c in text) > 0.5 * chars)
    return len(w), chars, symbols, dup, len(covered), failed, good


def test_quality_rules(spark):
    texts = [None, "", " \x0b\x0c ", "one two", "a b c d e " * 5, "x y\nx y\n\n z z\nx y\x00", "the quick brown fox jumps over the lazy dog again and again today"]
    texts += ["| a | b " * 20, "SHOUT " * 12 + "quiet", "a b c d e f g h i j\u00a0k l a b c d e", "é" * 50_000, "same line here\n" * 9, " ".join(f"w{i % 97}" for i in range(20_000)), "aa bb cc dd ee ff gg hh ii jj kk ll"]
    got = quality_rules.quality(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {i: brute_quality(t) for i, t in enumerate(texts)}
    kept = quality_rules.keep_good(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, t in enumerate(texts) if brute_quality(t)[-1]]


def test_url_filter_rules(spark):
    urls = ["http://A.Example.com/en/1?x=/es/", "https://www.example.com/en/2", "https://x.www.example.com/en/", "http://a.net/es/x", "http://net/fr/", "http://b.net/esx", "nothing", None, "http://c.com", "http://c.com/#f", "http://notexample.com/en/", "a://b://c.net/es/", "http://É.NET/es/q"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(df).collect()}
    assert got == {
        0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 2: ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("a.net", "/es/x", "net/es/", "block"), 4: ("net", "/fr/", "net/fr/", "block"), 5: ("b.net", "/esx", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("c.com", "", None, "allow"),
        9: ("c.com", "/", "com/", "allow"), 10: ("notexample.com", "/en/", "com/", "allow"), 11: ("b:", "//c.net/es/", None, "allow"), 12: ("É.net", "/es/q", "net/es/", "block"),
    }


def test_bad_templates_are_rejected(spark):
    good = [(f"/news/{i}/story-{i}", True) for i in range(30)]
    bad = [(f"/pills/{i}/buy", False) for i in range(30)]
    unknown = [("/pills/999/buy", None), ("/news/999/story-999", None), ("/about", None)]
    df = spark.createDataFrame([("h", p, g) for p, g in good + bad + unknown], "host string, path string, good boolean")
    got = {r["path"]: r["verdict"] for r in url_filters.template_verdicts(df).collect()}
    assert (got["/pills/999/buy"], got["/news/999/story-999"], got["/about"]) == ("block", "allow", "allow")


def test_kth_largest_is_exact(spark):
    import random

    rng = random.Random(2)
    values = [rng.choice([-(2**63), 2**63 - 1, 0, -1, rng.randrange(-(2**63), 2**63), rng.randrange(100)]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 2, 150, 300):
        assert quality_classifier.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_resampling_prefers_the_target(spark):
    import random

    rng = random.Random(7)
    make = lambda words: " ".join(rng.choice(words) for _ in range(60))
    clean, junk = [f"word{i}" for i in range(80)], [f"spam{i}" for i in range(30)]
    rows = [(i, make(clean if i % 4 else junk), "s") for i in range(800)] + [(900, None, "s"), (901, "", "s"), (None, make(clean), "s")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 800, 3)] + [(5000, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_classifier.resample(docs(spark, rows), labels).collect()}
    held_out = [i for i in range(800) if i % 3]
    assert sum(i in kept for i in held_out if i % 4) / sum(i % 4 > 0 for i in held_out) > 0.95
    assert sum(i in kept for i in held_out if not i % 4) / sum(i % 4 == 0 for i in held_out) < 0.1


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    for frame in (exact_dedup.exact_groups(none), exact_dedup.drop_copies(none), sharding.shard_rows(none), mixing.mix_plan(none, ["doc_id"]), mixing.mix(none), quality_rules.quality(none), quality_rules.keep_good(none), quality_classifier.resample(none, labels), url_filters.filter_urls(pages)):
        assert frame.count() == 0
