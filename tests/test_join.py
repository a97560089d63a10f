"""The similarity join against the measure on all pairs."""

import random
from difflib import SequenceMatcher

from veridict.operators import construction as con


def test_similar_against_all_pairs(spark):
    rng = random.Random(6)
    words = ["pruning", "keeps", "recall", "stable", "under", "noise", "and", "blur", "for", "small", "models", "too"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rows = [("ab"[k % 2], k, t) for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:15]):  # changed by a letter, a word, or blanks and case only
        changed = t[:-1] + "x" if k % 3 == 0 else t + " " + rng.choice(words) if k % 3 == 1 else "  " + t.upper().replace(" ", "\t ")
        rows.append(("ab"[(k + 1) % 2], 100 + k, changed))
    rows += [("a", 200, ""), ("b", 201, None)]
    normal = lambda t: " ".join((t or "").lower().split())
    want = sorted((i, j) for s, i, a in rows for u, j, b in rows if s < u and normal(a) and normal(b) and SequenceMatcher(None, normal(a), normal(b)).ratio() >= con.SIMILAR)
    got = con.similar(spark.createDataFrame([(s, k, t) for s, k, t in rows], "split string, instance_id long, text string"))
    assert sorted((r["left"], r["right"]) for r in got.collect()) == want and len(want) > 10
